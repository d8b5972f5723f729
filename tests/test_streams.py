"""Streams that keep state and let go of it: late rows, feeds page by page, a pinned pool; each with a restart."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from cadenza.operators import feeds as Fd
from cadenza.sources import sinks
from cadenza.streaming import feeds, pool, windows

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def counted(spark, out):
    return {(str(r["start"])[:10], r["event_type"]): r["n"] for r in spark.read.parquet(out).collect()}


def test_a_row_thirty_days_late_is_dropped_and_reported(spark, tmp_path):
    folder, out, checkpoint = (f"file://{tmp_path}/{name}" for name in ("in", "out", "checkpoint"))
    put(spark, [(i, START + i * DAY / 4, "play") for i in range(160)], windows.EVENTS, folder)  # 40 days
    first = windows.count_closed(spark, folder, out, checkpoint)
    first.awaitTermination()
    assert windows.dropped(first) == 0 and counted(spark, out)["2024-01-10", "play"] == 4
    again = [(1000, START + 9 * DAY, "play"), (159, START + 159 * DAY / 4, "play"), (1001, START + 39 * DAY, "skip"), (1002, START + 60 * DAY, "play")]
    put(spark, again, windows.EVENTS, folder)
    second = windows.count_closed(spark, folder, out, checkpoint)  # restarted from its checkpoint
    second.awaitTermination()
    assert windows.dropped(second) == 1
    got = counted(spark, out)
    assert got["2024-01-10", "play"] == 4  # the late row is not counted
    assert got["2024-02-09", "play"] == 4 and got["2024-02-09", "skip"] == 1  # a row sent twice is counted once
    assert ("2024-03-01", "play") not in got and len(got) == 41  # open windows are not written


def test_state_stays_bounded_over_many_batches(spark, tmp_path):
    folder, out, checkpoint = (f"file://{tmp_path}/{name}" for name in ("in", "out", "checkpoint"))
    for day in range(12):
        put(spark, [(day * 100 + i, START + day * DAY + i * DAY / 100, "play") for i in range(100)], windows.EVENTS, folder)
    query = windows.count_closed(spark, folder, out, checkpoint, files=1)
    query.awaitTermination()
    # At most the keys of some three days (a batch, and two of delay) and their windows, not those of all twelve.
    assert len(query.recentProgress) >= 12 and max(windows.held(query)) <= 310
    assert sum(counted(spark, out).values()) == 1000


PAGE = "listener long, feed string, position long, mbid string, heard boolean"


def pages(seed, listeners=3):
    rnd = random.Random(seed)
    return [
        (user, feed, position, f"m{rnd.randrange(25)}", rnd.random() < 0.2)
        for user in range(listeners)
        for feed, size in (("a", 23), ("b", rnd.randrange(5)), ("c", 40))
        for position in range(size)
    ]


def ends(rows):
    last = {}
    for user, feed, position, *_ in rows:
        last[user, feed] = max(last.get((user, feed), 0), position + 1)
    return [(user, feed, last.get((user, feed), 0), None, None) for user in {r[0] for r in rows} for feed in "abc"]


def in_one_batch(spark, rows, skip, unlistened):
    out = set()
    for user in {r[0] for r in rows}:
        one = spark.createDataFrame([(f, p, m, START if h else None) for u, f, p, m, h in rows if u == user], "feed string, position long, mbid string, latest_listened_at timestamp")
        out |= {(user, r["index"], r["feed"], r["mbid"]) for r in Fd.merged(one, skip, unlistened).collect()}
    return out


def test_pages_in_batches_get_the_indexes_of_one_batch(spark, tmp_path):
    folder, out, checkpoint = (f"file://{tmp_path}/{name}" for name in ("in", "out", "checkpoint"))
    rows, skip = pages(5), spark.createDataFrame([("m3",), ("m4",)], "mbid string")
    rnd = random.Random(6)
    dealt = [[], [], []]
    for row in rows:
        dealt[min(2, rnd.randrange(3) if row[1] != "a" else row[2] // 9)].append(row)  # pages come out of order and late
    dealt[2] += ends(rows) + dealt[1][:10]  # and some again
    for some in dealt:
        put(spark, some, PAGE, folder)
        feeds.merge_files(spark, folder, out, checkpoint, ["a", "b", "c"], skip, unlistened=True).awaitTermination()
    got = [(r["listener"], r["index"], r["feed"], r["mbid"]) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == in_one_batch(spark, rows, skip, True)


def test_a_feed_waits_for_its_page(spark, tmp_path):
    folder, out, checkpoint = (f"file://{tmp_path}/{name}" for name in ("in", "out", "checkpoint"))
    put(spark, [(1, "a", 0, "x", False), (1, "a", 1, "y", False), (1, "c", 0, "z", False)], PAGE, folder)
    feeds.merge_files(spark, folder, out, checkpoint, ["a", "b", "c"]).awaitTermination()
    assert [(r["index"], r["mbid"]) for r in spark.read.parquet(out).collect()] == [(1, "x")]  # b may still say something
    put(spark, [(1, "b", 0, None, None)], PAGE, folder)
    feeds.merge_files(spark, folder, out, checkpoint, ["a", "b", "c"]).awaitTermination()
    assert sorted((r["index"], r["mbid"]) for r in spark.read.parquet(out).collect()) == [(1, "x"), (2, "z"), (3, "y")]


def test_users_who_appear_later_are_never_admitted(spark, tmp_path):
    folder, index, out, checkpoint = (f"file://{tmp_path}/{name}" for name in ("in", "index", "out", "checkpoint"))

    def published(version, users):
        spark.createDataFrame([(u,) for u in users], "user_id long").write.parquet(f"{index}/{version}/user_stat")
        sinks.publish(spark, index, f"{index}/{version}", {})

    def run(rows):
        put(spark, rows, pool.PLAYS, folder)
        pool.admit_files(spark, folder, index, "user_stat", out, checkpoint).awaitTermination()
        return {(r["user_id"], r["mbid"]): r["n"] for r in spark.read.parquet(out).groupBy("user_id", "mbid").agg(F.sum("n").alias("n")).collect()}

    published("one", [1, 2])
    assert run([(1, "x"), (1, "x"), (3, "x")]) == {(1, "x"): 2}
    published("two", [1, 2, 3])
    assert run([(1, "x"), (3, "x"), (2, "y"), (None, "x")]) == {(1, "x"): 3, (2, "y"): 1}  # restarted, the pin stays
    assert pool.pin(spark, index, checkpoint) == f"{index}/one" and pool.pin(spark, index, f"{checkpoint}-other") == f"{index}/two"
