"""Sinks: complete or absent tables, published indexes, logs and caches.

All paths go through Hadoop's file system, so they may lie in any store that Spark reaches.
"""

from __future__ import annotations

import atexit
import bisect
import json
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import values as V


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """A table written by ``write_atomic`` is complete as soon as it has its name and its committer's mark."""
    return exists(spark, f"{path}/_SUCCESS")


def done(spark: SparkSession, path: str) -> bool:
    """A table is complete if its committer said so and its schema can be read."""
    if not exists(spark, f"{path}/_SUCCESS"):
        return False
    try:
        return bool(spark.read.parquet(path).columns)
    except Exception:
        return False


def write_atomic(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """zstd parquet under a temporary name, renamed when complete; a failure leaves the table of that name that there was, or none.

    The table before makes way by a rename and is deleted when the new one is in place.
    """
    spark = df.sparkSession
    part = f"{path}.writing-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(part)
    fs, target = _hadoop(spark, path)
    old = _hadoop(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot replace {path}")
    if not fs.rename(_hadoop(spark, part)[1], target):
        if had:
            fs.rename(old, target)  # as it was
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(old, True)


def step(df_of, spark: SparkSession, path: str, **kw) -> DataFrame:
    """Run a stage unless its table is complete (resume)."""
    if not done(spark, path):
        write_atomic(df_of(), path, **kw)
    return spark.read.parquet(path)


#: The folder of a session on one machine that names none: one per process, since a running session's setting cannot be changed.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the session runs on one machine (tests), a folder of our own is made and kept here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="cadenza-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = f"file://{_own[0]}"
    return folder.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one, for what only its own later plans read."""
    return f"{shared_dir(spark)}/cadenza-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """The same rows behind a table of the shared folder: later plans start there, and so does recovery."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for table in tables:
        fs, path = _hadoop(table.sparkSession, table.staged_at)
        fs.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete everything that this application has staged, once its results are written elsewhere."""
    fs, path = _hadoop(spark, run_dir(spark))
    fs.delete(path, True)


def write_buckets(rows: DataFrame, path: str) -> None:
    """A table of users' rows by bucket of the user; a few tasks per bucket write, not one file per task and bucket."""
    rows = rows.withColumn("bucket", V.bucket(F.col("user_id")))
    write_atomic(rows.repartition("bucket", F.pmod(F.xxhash64("user_id"), F.lit(8))), path, "bucket")


def buckets(spark: SparkSession, path: str) -> list[str]:
    """The buckets that a table written by bucket has."""
    fs, folder = _hadoop(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n.removeprefix("bucket=") for n in names if n.startswith("bucket="))


def files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path without scheme, length) of a table's files, in all its folders; contents are not read."""
    fs, place = _hadoop(spark, folder)
    found, listed = [], fs.listFiles(place, True)
    while listed.hasNext():
        status = listed.next()
        path = status.getPath().toUri().getPath()
        if not any(part.startswith(("_", ".")) for part in path.removeprefix(place.toUri().getPath()).split("/")):
            found.append((path, status.getLen()))
    return found


def dealt(lengths: Sequence[tuple[str, int]], aim: int) -> list[tuple[str, int, int]]:
    """(file, first output, how many outputs) so that outputs hold about ``aim`` bytes.

    Files above the aim are spread over outputs of their own.  The others are packed in decreasing order of size, each
    into the output with the least room that it fits: at most one output stays less than half full.
    """
    plan, outputs = [], 0
    room: list[tuple[int, int]] = []  # (bytes left, output), sorted
    for path, length in sorted(lengths, key=lambda f: (-f[1], f[0])):
        if length > aim:
            n = max(1, round(length / aim))
            plan.append((path, outputs, n))
            outputs += n
            continue
        at = bisect.bisect_left(room, (length, -1))
        if at < len(room):
            left, output = room.pop(at)
        else:
            left, output = aim, outputs
            outputs += 1
        plan.append((path, output, 1))
        bisect.insort(room, (left - length, output))
    return plan


def compact(spark: SparkSession, folder: str, target: str, aim: int = 256 << 20, drop: Sequence[str] = ("bucket",)) -> DataFrame:
    """The rows of ``folder``, whatever its files are like, as one table of files of about ``aim`` bytes.

    Rows go straight to the output that their file was dealt to; rows of a large file are spread by a hash of all columns.
    """
    plan = dealt(files(spark, folder), aim)
    rows = spark.read.parquet(folder)
    if not plan:
        write_atomic(rows.drop(*drop), target)
        return spark.read.parquet(target)
    # One row per file: paths and two numbers.
    told = F.broadcast(spark.createDataFrame(plan, "_file string, _output int, _n int"))
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^[A-Za-z0-9]+:(?://[^/]*)?", "")
    spread = F.pmod(F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) for c in rows.columns]), F.col("_n")).cast("int")
    placed = rows.withColumn("_file", path).join(told, "_file").withColumn("_output", F.col("_output") + spread)
    outputs = max(first + n for _, first, n in plan)
    write_atomic(placed.repartitionById(outputs, "_output").drop("_file", "_output", "_n", *drop), target)
    return spark.read.parquet(target)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, target = _hadoop(spark, path)
        fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, written under a temporary name first: it is whole or absent."""
    fs, target = _hadoop(spark, path)
    _, part = _hadoop(spark, f"{path}.writing-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, target):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def _pointers(spark: SparkSession, index: str) -> list[int]:
    """The numbers of an index's pointers, oldest first."""
    fs, folder = _hadoop(spark, index)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[len("meta-") : -len(".json")]) for n in names if n.startswith("meta-") and n.endswith(".json"))


def _pointer(index: str, number: int) -> str:
    return f"{index}/meta-{number:012d}.json"


def publish(spark: SparkSession, index: str, version: str, meta: dict) -> None:
    """Point the index at a version whose tables are complete.

    Each pointer is a new file with the next number, and readers take the highest: there is one at every
    moment, before and after a crash.  The pointer before stays for readers that have just listed it.
    """
    numbers = _pointers(spark, index)
    write_text(spark, _pointer(index, numbers[-1] + 1 if numbers else 0), json.dumps(meta | {"version": version}, sort_keys=True))
    for number in numbers[:-1]:
        fs, old = _hadoop(spark, _pointer(index, number))
        fs.delete(old, False)


def meta(spark: SparkSession, index: str) -> dict | None:
    numbers = _pointers(spark, index)
    text = read_text(spark, _pointer(index, numbers[-1])) if numbers else None
    return json.loads(text) if text else None


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    rows.write.mode("append").json(path)


def append_declined(ids: DataFrame, path: str) -> None:
    ids.select("mbid").write.mode("append").text(path)


def read_declined(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a declined list; lines that are none are skipped."""
    from cadenza.functions.text import to_uuid

    if not exists(spark, path):
        return spark.createDataFrame([], "mbid string")
    return spark.read.text(path).select(to_uuid(F.col("value")).alias("mbid")).where("mbid IS NOT NULL").distinct()


def write_playlist(spark: SparkSession, entries: DataFrame, path: str, extension: str = "opus") -> None:
    """Sorted file names, in files whose names keep the order; an empty playlist has none."""
    if entries.isEmpty():
        fs, target = _hadoop(spark, path)
        fs.delete(target, True)
        return
    entries.select(F.concat("mbid", F.lit(f".{extension}")).alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").text(path)


def edit_q(lines: DataFrame, mbid: str, q: int, value: str = "value") -> DataFrame:
    """A declaration's lines with one entry's q changed; everything else stays as it is."""
    mine = F.contains(F.lower(F.col(value)), F.lit(f'"{mbid.lower()}"'))
    return lines.withColumn(value, F.when(mine, F.regexp_replace(value, r"(\bq:\s*)[0-9]+", f"$1{q}")).otherwise(F.col(value)))


def append_entry(declared: DataFrame, entry: DataFrame) -> DataFrame:
    return declared.unionByName(entry.join(declared, "s", "left_anti"))


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """A cached table, or None if it is absent or damaged."""
    return spark.read.parquet(path) if done(spark, path) else None
