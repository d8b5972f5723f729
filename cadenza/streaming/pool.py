"""A pool of users that a stream is held to: a stream-static semi join with one version of a table.

Which version that is follows from the index's pointer when the stream starts for the first time; it is written
beside the checkpoint, once, and every restart reads it there.  Users who join the pool later are never admitted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cadenza.sources import sinks

PLAYS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("recording_mbid", T.StringType())])


def pin(spark: SparkSession, index: str, checkpoint: str) -> str:
    """The version that a stream of this checkpoint is held to."""
    place = f"{checkpoint}.pin.json"
    text = sinks.read_text(spark, place)
    if text is None:
        meta = sinks.meta(spark, index)
        if meta is None:
            raise FileNotFoundError(index)
        text = json.dumps({"version": meta["version"]})
        sinks.write_text(spark, place, text)
    return json.loads(text)["version"]


def admitted(plays: DataFrame, pool: DataFrame) -> DataFrame:
    """The plays of the pool's users: the stream stays where it is if the pool is small, and keeps no state."""
    return plays.join(pool.select("user_id").distinct(), "user_id", "left_semi")


def admit_files(spark: SparkSession, folder: str, index: str, part: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append to ``out`` (user_id, mbid, n), each batch's plays of users of the pinned version's ``part``; later batches add to it."""
    pool = spark.read.parquet(f"{pin(spark, index, checkpoint)}/{part}")

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is tried again replaces what it wrote.
        counts = batch.groupBy("user_id", F.col("recording_mbid").alias("mbid")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    plays = spark.readStream.schema(PLAYS).option("maxFilesPerTrigger", 16).parquet(folder)
    return admitted(plays, pool).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
