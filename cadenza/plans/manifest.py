"""What a stage was made from: fingerprints of inputs, keys of stages, and the record of both.

A source's fingerprint is its files (path, length, time of change), its schema and the plan over them; a frame
without files is read once and its rows are digested.  A stage's key follows from its name, the format's version and
the keys or fingerprints of what it reads, and its table lies in a folder of that key: a stage is built again if and
only if something that it depends on has changed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.sources import sinks

#: To be raised whenever a stage's contents change their meaning: tables of another format are never read.
FORMAT = 3


def stamp(*facts: object) -> str:
    return hashlib.sha256(repr(facts).encode()).hexdigest()[:16]


def _files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of files, with one listing per folder."""
    wanted, found = set(paths), []
    for folder in sorted({p.rpartition("/")[0] for p in paths}):
        fs, place = sinks._hadoop(spark, folder)
        for status in fs.listStatus(place):
            name = f"{folder}/{status.getPath().getName()}"
            if name in wanted:
                found.append((name, status.getLen(), status.getModificationTime()))
    return sorted(found)


def listed(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(name, length, time of change) of what a folder holds, itself and one level below."""
    fs, place = sinks._hadoop(spark, folder)
    found = []
    for status in fs.listStatus(place):
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in inner]
    return sorted(found)


def fingerprint(df: DataFrame) -> str:
    """What tells a frame from one of other contents, at the price of a listing; frames without files are read once."""
    paths = sorted(df.inputFiles())
    if paths:
        # Canonical: the numbers that Spark gives to columns are left out.
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
        return stamp("files", _files(df.sparkSession, paths), df.schema.json(), plan)
    row = F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) for c in df.columns])
    told = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s")).first()
    return stamp("rows", tuple(told), df.schema.json())


@dataclass
class Manifest:
    """The stages of a build: their keys, folders and whether they had to be built."""

    spark: SparkSession
    index: str
    keys: dict[str, str] = field(default_factory=dict)
    built: dict[str, bool] = field(default_factory=dict)

    def stage(self, name: str, inputs: list[str], make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None] = sinks.write_atomic, schema: T.StructType | None = None) -> DataFrame:
        """The table of a stage that reads ``inputs``: other stages by name, or fingerprints.

        A table by bucket needs its ``schema``: without rows it has no file that says it.
        """
        self.keys[name] = stamp(FORMAT, name, *(self.keys.get(i, i) for i in inputs))
        self.built[name] = not sinks.complete(self.spark, self.folder(name))
        if self.built[name]:
            write(make(), self.folder(name))
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(self.folder(name))

    def folder(self, name: str) -> str:
        return f"{self.index}/{name}-{self.keys[name]}"

    def version(self, parts: tuple[str, ...]) -> str:
        """The folder of the record that says where each of ``parts`` lies; written once."""
        folder = f"{self.index}/version-{stamp(*(self.keys[p] for p in parts))}"
        place = f"{folder}/manifest.json"
        if not sinks.exists(self.spark, place):
            sinks.write_text(self.spark, place, json.dumps({"format": FORMAT, "parts": {p: self.folder(p) for p in parts}, "keys": self.keys}, sort_keys=True))
        return folder


def parts_of(spark: SparkSession, version: str) -> dict[str, str]:
    """Where the parts of a version lie, by its record; none if it has no record."""
    text = sinks.read_text(spark, f"{version}/manifest.json")
    return json.loads(text)["parts"] if text else {}
