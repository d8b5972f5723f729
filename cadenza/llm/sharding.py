"""Sharding (native): rendezvous hashing of stable record keys over weighted shards.

Each shard scores a record by ``-weight / ln(u)`` with ``u`` a uniform hash of (key, shard); the highest
score wins.  The key is doc_id alone, so a text may change without moving, and when a shard is added a
record moves only if the new shard wins it.

Slots are positions inside a shard, gapless from 0.  Rows that agree in key, size and checksum differ in
nothing that is reported but their slot, so they are counted first, and a class of any number of them is one
row until its slots are listed.  A shard is cut into sub-ranges by a hash of all three; the sub-ranges' counts
give each one's offset, and classes are numbered inside a sub-range only: no task ever sorts a whole shard, or
all rows of one key.

Edge cases: null keys share one hash; repeated keys go to one shard and get slots of their own; null texts
have size 8 and checksum 0 (that of no bytes); extra columns are kept by ``assign`` and left out by
``report``.  ``weights`` must be positive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import each_of, free_name, materialize, table

SHARDS = 24
ROW_OVERHEAD = 8
#: Rows that one numbering task should get; sub-ranges are made from the table's count.
SUB_ROWS = 50_000


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest rendezvous score; ties go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def score(shard: int, weight: float) -> Column:
        # 52 high bits, moved to the middle of their step: never 0 and never 1.
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("long")), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.lit(-float(weight)) / F.ln(u)

    scored = [F.struct(score(i, w).alias("score"), F.lit(-i).alias("minus")) for i, w in enumerate(weights)]
    return (-(F.greatest(*scored)["minus"] if len(scored) > 1 else F.lit(0))).cast("int")


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0, key: str = "doc_id") -> DataFrame:
    """``docs`` with shard and grown_shard (one more shard of ``grown_weight``)."""
    grown = winner(docs[key], [*weights, grown_weight])
    return docs.withColumns({"shard": winner(docs[key], weights), "grown_shard": grown})


def report(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = ["doc_id", "size", "text_crc32"]
    sized = docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    subs = max(1, docs.count() // (len(weights) * SUB_ROWS))
    counted = assign(sized.groupBy(*facts).agg(F.count("*").alias("n")), weights)
    # Written once: the counts and the numbering below both start from it, not from the texts.
    classes = materialize(counted.withColumn("sub", F.pmod(F.xxhash64(F.lit("sub"), *facts), F.lit(subs)).cast("int")), "shard-classes")
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("n").over(before("sub").partitionBy("shard")), F.lit(0).cast("long"))
    # len(weights) x subs counts, one per SUB_ROWS rows; Spark broadcasts them only if they are small.
    offsets = classes.groupBy("shard", "sub").agg(F.sum("n").alias("n")).select("shard", "sub", total.alias("offset"))
    inside = F.coalesce(F.sum("n").over(before(*facts).partitionBy("shard", "sub")), F.lit(0).cast("long"))
    placed = classes.withColumn("inside", inside).join(offsets, ["shard", "sub"]).withColumn("first", F.col("offset") + F.col("inside"))
    slot = each_of(placed, "n", "nth").withColumn("slot", F.col("first") + F.col("nth"))
    return slot.select(*facts, F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS) -> None:
    """Write the table as one folder per shard; each row is shuffled once, a shard's rows over several tasks."""
    folder = free_name(docs, "shard_id")
    placed = docs.withColumn(folder, winner(docs["doc_id"], weights))
    placed.repartition(F.col(folder), F.pmod(F.xxhash64("doc_id", "text"), F.lit(16))).write.partitionBy(folder).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
