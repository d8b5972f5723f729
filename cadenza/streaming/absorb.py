"""Absorb dated files of plays as a stream.

Each file names the window it covers (columns start and end, 14-digit numbers).  A micro-batch may hold
several windows; they are judged in order of their ends and folded in one pass.  What is covered lives in the index's meta
record, written last, so a batch that is tried again finds its windows covered and folds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cadenza import schema as S
from cadenza.plans import index as I

INCREMENT = T.StructType([*S.LISTENED.fields, T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def fold_batch(index: str):
    def fold(batch: DataFrame, _: int) -> None:
        # One row per dated file of the batch; their rows are folded in one pass.
        windows = batch.select("start", "end").distinct().collect()
        if windows:
            I.absorb_all(batch.sparkSession, batch, index, [(f"{w['start']}-{w['end']}", w["start"], w["end"]) for w in windows])

    return fold


def start(spark: SparkSession, folder: str, index: str, checkpoint: str) -> StreamingQuery:
    """Fold what lies in ``folder`` and what arrives; stops when all available files are folded."""
    listens = spark.readStream.schema(INCREMENT).option("maxFilesPerTrigger", 16).parquet(folder)
    return listens.writeStream.foreachBatch(fold_batch(index)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def plays_per_window(listens: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Plays per day and kind from an event stream (ts, event_type).

    In complete mode all windows are kept and late rows still count; windows that close, with rows that are dropped, are
    those of :mod:`cadenza.streaming.windows`.
    """
    return listens.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


EVENTS = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("event_type", T.StringType())])


def count_files(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Count the plays of each day and kind in the files of ``folder`` that were not counted yet.

    A micro-batch writes its counts under its own number, so one that is tried again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    plays = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 16).parquet(folder)
    return plays.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, out: str) -> DataFrame:
    """(day, event_type, n) over all micro-batches."""
    return spark.read.parquet(out).groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def count_windows(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """``plays_per_window`` of the files of ``path`` as a stream, its whole state written after each micro-batch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    plays = spark.readStream.schema(EVENTS).parquet(path)
    return plays_per_window(plays).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
