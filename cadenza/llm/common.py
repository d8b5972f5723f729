"""What the operators of this folder share: tables, the shared folder and word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.sinks import discard, run_dir, shared_dir
from cadenza.sources.sinks import staged as materialize

__all__ = ["WORD", "WORD_ANY_CASE", "WORD_BYTES", "ascii_lower", "columns", "comparable", "discard", "each_of", "free_name", "marks", "materialize", "run_dir", "shared_dir", "sieve", "split", "table", "word_array"]

#: Words of the decontamination contract: runs of digits, a-z and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text whose capitals are kept.
WORD_ANY_CASE = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
#: The same class over UTF-8 bytes whose A-Z are already lower-cased.
WORD_BYTES = rb"[0-9a-z\x80-\xff]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a sieve: 16 MB, whatever the input.
SIEVE_BITS = 1 << 27
_SIEVE_SEED = 5
#: Characters that Java's lower() changes, A-Z apart.
_OTHER_UPPER = r"[[\p{javaUpperCase}\p{javaTitleCase}]&&[^A-Z]]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters are in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def comparable(df: DataFrame, column: str) -> Column:
    """A column as something that can be hashed: maps, which cannot, become JSON text."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    return F.to_json(F.struct(value)) if "map<" in kind.simpleString() or kind.simpleString() == "variant" else value


def marks(*columns: Column | str) -> list[Column]:
    """Two 64-bit hashes of a row's columns.  Nulls count, so that moving a value to another column changes them."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    seen = [x for c in named for x in (c, c.isNull())]
    return [F.xxhash64(*seen), F.xxhash64(F.lit("second"), *seen)]


def _flagged(df: DataFrame, wanted: DataFrame, key: str, flag: str, bits: int) -> DataFrame:
    """``df`` with ``flag``: whether its ``key`` may be among ``wanted``'s.

    One bit stands for each hash of a wanted key, in bitmaps of 4 KB that are broadcast: ``bits`` / 8 bytes at
    most, however many keys there are.  Every wanted row is flagged; of the others a share of at most the wanted
    keys over ``bits`` is.
    """
    place = F.pmod(F.xxhash64(F.col(key), F.lit(_SIEVE_SEED)), F.lit(bits))
    maps = wanted.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("cell")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bitmap"))
    cell, bitmap, spot = free_name(df, "cell"), free_name(df, "bitmap"), place % 32768
    found = df.join(F.broadcast(maps.select(F.col("cell").alias(cell), F.col("bitmap").alias(bitmap))), F.shiftright(place, 15) == F.col(cell), "left")
    byte = F.substring(F.col(bitmap), (spot / 8).cast("int") + 1, F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (spot % 8).cast("int")) == 1
    return found.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(cell, bitmap)


def sieve(df: DataFrame, wanted: DataFrame, key: str, bits: int = SIEVE_BITS) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among ``wanted``'s, to be joined by the caller: the shuffle then
    carries little but what the join keeps."""
    flag = free_name(df, "flag")
    return _flagged(df, wanted, key, flag, bits).where(flag).drop(flag)


def split(df: DataFrame, wanted: DataFrame, key: str, bits: int = SIEVE_BITS) -> tuple[DataFrame, DataFrame]:
    """(maybe, rest): rows whose ``key`` may be among ``wanted``'s, and rows whose key surely is not.

    Only the former need a shuffle to be told apart; the latter stay where they are.
    """
    flag = free_name(df, "flag")
    flagged = _flagged(df, wanted, key, flag, bits)
    return flagged.where(flag).drop(flag), flagged.where(~F.col(flag)).drop(flag)


def each_of(df: DataFrame, n: str, nth: str, chunk: int = 1 << 16) -> DataFrame:
    """Each row ``n`` times (not at all for 0), with ``nth`` from 0 in place of ``n``.

    Numbers are listed by chunks, so that no array holds all those of a very large count.
    """
    start = free_name(df, "start")
    chunked = df.where(F.col(n) > 0).withColumn(start, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(chunk).cast("long"))))
    upto = F.least(F.col(start) + chunk, F.col(n).cast("long")) - 1
    return chunked.withColumn(nth, F.explode(F.sequence(F.col(start), upto))).drop(start, n)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is the empty string.

    ``lower`` is much faster than ``translate``, and the same for texts without other capitals.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
