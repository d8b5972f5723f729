"""Windowed counts of an event stream whose state ends.

Rows later than the watermark are dropped and counted, rows sent twice within it count once, and a window is written
once, when the watermark has passed its end; its state is gone then.  What is kept is bounded by what arrives within
the watermark's delay, however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("event_type", T.StringType())])


def closed_windows(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(window, event_type, n) in append mode, from (event_id, ts, event_type)."""
    fresh = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return fresh.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def count_closed(spark: SparkSession, folder: str, out: str, checkpoint: str, late: str = "1 day", width: str = "1 day", files: int = 16) -> StreamingQuery:
    """Count what lies in ``folder`` and was not read yet; the file sink's log makes each window appear once, after restarts too.

    The query stops when all available files are read.  Windows that may still grow stay in its checkpoint.
    """
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)
    flat = closed_windows(events, late, width).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")
    return flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped(query: StreamingQuery) -> int:
    """Rows that came too late, by the query's progress (of the last ``spark.sql.streaming.numRecentProgressUpdates`` batches).

    The first operator with state is the one that drops them, so its count is one of rows.
    """
    return sum(p["stateOperators"][-1]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])


def held(query: StreamingQuery) -> list[int]:
    """Rows in all state after each batch."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
