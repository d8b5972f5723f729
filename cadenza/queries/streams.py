"""Streams over the events table, each stopped and started again in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ordered import numbered
from cadenza.queries.standin import Inputs
from cadenza.sources import sinks
from cadenza.streaming import feeds, pool, windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs.of(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


def _place(i: Inputs, name: str) -> str:
    return f"{sinks.run_dir(i.spark)}/{name}-{uuid.uuid4().hex}"


# What comes first, and what comes after the stream was started again: the second half, every 50th row of the first
# half for the first time, and every 40th for the second time.
_SENT = """first AS (SELECT event_id, ts, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_id % 50 <> 0),
second AS (SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16' OR event_id % 50 = 0 UNION ALL SELECT * FROM first WHERE event_id % 40 = 1),
mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS w FROM first),
last AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS w FROM events)"""


def _counted(i: Inputs):
    """The two queries that count, and where their windows are."""
    place = _place(i, "closed")
    events = i.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    first = events.where(half & (F.col("event_id") % 50 != 0))
    second = events.where(~half | (F.col("event_id") % 50 == 0)).unionByName(first.where("event_id % 40 = 1"))
    runs = []
    for some in (first, second):
        some.write.mode("append").parquet(f"{place}/in")
        # All files of a run are one batch, so that what is late does not depend on their number.
        runs.append(windows.count_closed(i.spark, f"{place}/in", f"{place}/out", f"{place}/checkpoint", files=100_000))
        runs[-1].awaitTermination()
    return runs, f"{place}/out"


@query("stream_closed_windows", f"""WITH {_SENT}, kept AS (SELECT * FROM first UNION SELECT event_id, ts, event_type FROM second, mark WHERE ts > w)
SELECT CAST(ts::DATE AS VARCHAR) AS day, event_type, count(*) AS n FROM kept, last WHERE ts::DATE + INTERVAL 1 DAY <= w GROUP BY 1, 2""")
def _(i: Inputs) -> DataFrame:
    """Windows that the watermark has closed: late rows and rows sent twice do not count."""
    _, out = _counted(i)
    return i.spark.read.parquet(out).select(F.to_date("start").cast("string").alias("day"), "event_type", "n")


@query("stream_late_rows", f"WITH {_SENT} SELECT CAST(1 AS BIGINT) AS run, CAST(0 AS BIGINT) AS late UNION ALL SELECT 2, count(*) FROM second, mark WHERE ts <= w")
def _(i: Inputs) -> DataFrame:
    """Rows that each run dropped, as its progress says."""
    runs, _ = _counted(i)
    return i.spark.createDataFrame([(n, windows.dropped(run)) for n, run in enumerate(runs, 1)], "run long, late long")


_PAGES = """page AS (SELECT user_id % 8 AS listener, event_type AS feed, row_number() OVER (PARTITION BY user_id % 8, event_type ORDER BY ts, event_id) - 1 AS position,
  concat('m', event_id * 7 % 1009) AS mbid, event_id * 7 % 1009 AS k, event_id % 5 = 0 AS heard FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY listener ORDER BY position, feed) AS idx FROM page)"""


@query("feed_stream", f"""WITH {_PAGES} SELECT listener, CAST(min(idx) AS BIGINT) AS idx, min_by(feed, idx) AS feed, mbid FROM placed WHERE NOT heard AND k % 6 <> 0 GROUP BY listener, mbid""")
def _(i: Inputs) -> DataFrame:
    """The merged feeds of eight listeners, whose pages of 25 arrive in turns: every second one first, the others after a restart."""
    place = _place(i, "feeds")
    key = F.col("event_id") * 7 % 1009
    rows = i.table("events").select((F.col("user_id") % 8).alias("listener"), F.col("event_type").alias("feed"), "ts", "event_id", key.alias("k"), F.concat(F.lit("m"), key.cast("string")).alias("mbid"), (F.col("event_id") % 5 == 0).alias("heard"))
    pages = sinks.staged(numbered(rows, "ts", "event_id", name="position", by=("listener", "feed")).drop("ts", "event_id"), "pages")
    kinds = [r["feed"] for r in pages.select("feed").distinct().orderBy("feed").collect()]  # as many as there are kinds of events
    every = pages.select("listener").distinct().crossJoin(F.broadcast(i.spark.createDataFrame([(k,) for k in kinds], "feed string")))
    size = pages.groupBy("listener", "feed").agg(F.count("*").alias("position"))
    ends = every.join(size, ["listener", "feed"], "left").select("listener", "feed", F.coalesce("position", F.lit(0)).alias("position"), F.lit(None).cast("string").alias("mbid"), F.lit(None).cast("boolean").alias("heard"))
    odd = F.call_function("div", F.col("position"), F.lit(25).cast("long")) % 2 == 1
    skip = pages.where("k % 6 = 0").select("mbid").distinct()
    for some in (pages.where(~odd).drop("k"), pages.where(odd).drop("k").unionByName(ends)):
        some.write.mode("append").parquet(f"{place}/in")
        feeds.merge_files(i.spark, f"{place}/in", f"{place}/out", f"{place}/checkpoint", kinds, skip, unlistened=True).awaitTermination()
    return i.spark.read.parquet(f"{place}/out").select("listener", F.col("index").alias("idx"), "feed", "mbid")


@query("stream_pool_frozen", "SELECT user_id, event_type AS mbid, CAST(least(count(*), 65535) AS INTEGER) AS plays FROM events SEMI JOIN (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 2 = 0) USING (user_id) GROUP BY 1, 2")
def _(i: Inputs) -> DataFrame:
    """Plays of the pool that was published when the stream began; in between a version with all customers is published."""
    place = _place(i, "pool")
    users = i.table("customer").select(F.col("c_custkey").alias("user_id"))
    plays = i.table("events").select("user_id", F.col("event_type").alias("recording_mbid"), "event_id")
    for version, members, some in (("one", users.where("user_id % 2 = 0"), plays.where("event_id % 2 = 0")), ("two", users, plays.where("event_id % 2 <> 0"))):
        sinks.write_atomic(members, f"{place}/{version}/user_stat")
        sinks.publish(i.spark, place, f"{place}/{version}", {})
        some.select("user_id", "recording_mbid").write.mode("append").parquet(f"{place}/in")
        pool.admit_files(i.spark, f"{place}/in", place, "user_stat", f"{place}/out", f"{place}/checkpoint").awaitTermination()
    counts = i.spark.read.parquet(f"{place}/out").groupBy("user_id", "mbid").agg(F.sum("n").alias("n"))
    return counts.select("user_id", "mbid", F.least("n", F.lit(65535)).cast("int").alias("plays"))
