"""Desired against actual: tiers, playlists, ratings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza import schema as S
from cadenza.functions import values as V
from cadenza.sources.sinks import staged


def tiers(declared: DataFrame) -> DataFrame:
    """(tier, mbid): an entry of q belongs to all tiers from 0 to q."""
    return declared.select(F.explode(F.sequence(F.lit(0), F.col("q").cast("int"))).alias("tier"), "mbid")


def playlists(declared: DataFrame) -> DataFrame:
    return declared.select(F.explode("playlist").alias("playlist"), "mbid").distinct()


def to_add(desired: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    return desired.select(group, "mbid").distinct().join(actual, [group, "mbid"], "left_anti")


def to_remove(desired: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    return actual.select(group, "mbid").distinct().join(desired, [group, "mbid"], "left_anti")


def diff(desired: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """(group, action, mbid); groups without any change have no row."""
    mark = lambda rows, action: rows.select(group, F.lit(action).alias("action"), "mbid")
    return mark(to_add(desired, actual, group), "add").unionByName(mark(to_remove(desired, actual, group), "remove"))


def rating_diff(declared: DataFrame, submitted: DataFrame) -> DataFrame:
    """(mbid, value) whose submitted value differs or is missing."""
    value = V.q_value(F.col("q")).cast("long")
    rated = declared.select("mbid", value.alias("value")).join(submitted.select("mbid", F.col("value").alias("was")), "mbid", "left")
    return rated.where(~F.col("value").eqNullSafe(F.col("was"))).select("mbid", "value")


def rating_chunks(pending: DataFrame, size: int = S.RATING_CHUNK) -> DataFrame:
    """(chunk, n, body): XML bodies of ``size`` ratings each, in the order of ids.

    Numbers come from ranges of ids, so no task sorts all ratings.
    """
    from cadenza.operators.library import surrogate_keys

    numbered = surrogate_keys(pending).withColumnRenamed("recording_id", "number").join(pending, "mbid")
    item = F.concat(F.lit('<recording id="'), "mbid", F.lit('"><user-rating>'), F.col("value").cast("string"), F.lit("</user-rating></recording>"))
    chunks = numbered.groupBy(F.floor(F.col("number") / size).cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("number", item.alias("xml")))).alias("items"))
    return chunks.select("chunk", "n", F.array_join(F.transform("items", lambda i: i["xml"]), "").alias("body"))


def report(changes: DataFrame, group: str, limit: int = S.SHOWN_LIMIT) -> DataFrame:
    """(group, action, n, shown): up to ``limit`` ids of a list that short, otherwise none but the count."""
    counted = changes.groupBy(group, "action").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group, "action").orderBy("mbid"))
    few = changes.withColumn("rank", rank).where(F.col("rank") <= limit).groupBy(group, "action").agg(F.array_join(F.array_sort(F.collect_list("mbid")), ",").alias("ids"))
    return counted.join(few, [group, "action"]).select(group, "action", "n", F.when(F.col("n") <= limit, F.col("ids")).otherwise("").alias("shown"))


def first_success(tries: DataFrame) -> DataFrame:
    """(mbid, url): the best source that worked, from (mbid, url, priority, ok)."""
    return tries.where("ok").groupBy("mbid").agg(F.min_by("url", F.struct("priority", "url")).alias("url"))


def _ends(steps: DataFrame, stops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(found, open): follow ``steps`` (id, target) to where they end, by doubling.

    ``found`` (id, end) are ids whose way ends, at a target without a step of its own or among ``stops`` (id);
    ``open`` (id, far) those that run in circles, with where they are after as many steps as the last round made.
    In round k ways of up to 2^k steps end.  Every way holds all shorter ones of its targets, so once a round ends
    none, all that are left are circular: the number of rounds is the logarithm of the longest way.
    """
    last = steps.select(F.col("id").alias("target")).distinct().withColumn("goes_on", F.lit(True))
    if stops is not None:
        last = last.join(stops.select(F.col("id").alias("target")), "target", "left_anti")
    moves = staged(steps.join(last, "target", "left").select("id", F.col("target").alias("far"), F.col("goes_on").isNull().alias("over")), "chase")
    ended = []
    while True:
        now = moves.where("over").select("id", F.col("far").alias("end"))
        if now.isEmpty():
            break
        ended.append(now)
        every = moves.where("NOT over").select(F.col("id").alias("far"), F.col("far").alias("further"), "over")
        for part in ended:
            every = every.unionByName(part.select(F.col("id").alias("far"), F.col("end").alias("further"), F.lit(True).alias("over")))
        moves = staged(moves.where("NOT over").select("id", "far").join(every, "far").select("id", F.col("further").alias("far"), "over"), "chase")
    found = steps.select("id", F.col("target").alias("end")).limit(0)
    for part in ended:
        found = found.unionByName(part)
    return found, moves.select("id", "far")


def _circles(open_: DataFrame) -> DataFrame:
    """(id): the members of the circles that all of ``open_`` (id, far) lead into.

    Where a number of steps leads, from all of them, is the circles and what of the ways into them is longer than
    that; doubled, it is the circles as soon as it stays as large as it was.
    """
    reached, size = open_.select(F.col("far").alias("id")).distinct(), -1
    while (now := reached.count()) != size:
        size = now
        onward = open_.select(F.col("id").alias("far"), F.col("far").alias("further"))
        open_ = staged(open_.join(onward, "far").select("id", F.col("further").alias("far")), "chase")
        reached = open_.select(F.col("far").alias("id")).distinct()
    return reached


def chase(start: DataFrame, redirect: DataFrame) -> DataFrame:
    """(id, live): follow (id, target) until there is no target, or the target has been met on the way.

    A way into a circle goes around it once and ends before the member where it came in; one that starts in a circle
    ends before its start.  Chains of n links take about log n rounds, each from a table.  Of several targets of an id
    the smallest counts; ids and targets that are null lead nowhere.
    """
    steps = staged(redirect.where("id IS NOT NULL AND target IS NOT NULL").groupBy("id").agg(F.min("target").alias("target")), "steps")
    found, open_ = _ends(steps)
    live = found.withColumnRenamed("end", "live")
    if not open_.isEmpty():
        ring = staged(_circles(open_), "ring")
        before = steps.join(ring, "id", "left_semi").select(F.col("target").alias("entry"), F.col("id").alias("live"))
        ways = steps.join(open_.select("id"), "id", "left_semi").join(ring, "id", "left_anti")
        entries = _ends(ways, ring)[0].withColumnRenamed("end", "entry").unionByName(ring.select("id", F.col("id").alias("entry")))
        live = live.unionByName(entries.join(before, "entry").select("id", "live"))
    return start.select("id").join(live, "id", "left").select("id", F.coalesce("live", "id").alias("live"))
