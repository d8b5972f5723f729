"""From raw listens to the star schema: plays per user and recording, keys, pools and statistics.

``user_id`` and ``recording_id`` are the shuffle keys.  Each step is one plan that Spark aggregates partly
before its shuffle; nothing here is collected, but for the two candidates of ``own_user``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza import schema as S
from cadenza.functions import values as V
from cadenza.operators.ordered import dealt, numbered


def count_plays(listens: DataFrame, plays: str | None = None) -> DataFrame:
    """(user_id, mbid, plays): listens per user and recording, saturating; ``plays`` names a column of counts."""
    n = F.sum(F.col(plays)) if plays else F.count("*")
    known = listens.where(F.col("recording_mbid").isNotNull())
    return known.groupBy(F.col("user_id").cast("long").alias("user_id"), F.col("recording_mbid").alias("mbid")).agg(V.saturated(n).alias("plays"))


def count_numbered(listens: DataFrame, recording: DataFrame) -> DataFrame:
    """(user_id, recording_id, plays): as ``count_plays``, by the numbers of ``recording``.

    Ids, which are long, are shuffled once: where they are dealt by recordings they are counted and numbered.
    """
    rows = listens.count()
    counts = count_plays(dealt(listens.select("user_id", "recording_mbid"), rows, "recording_mbid"))
    return counts.join(dealt(recording.select("recording_id", "mbid"), rows, "mbid"), "mbid").select("user_id", "recording_id", "plays")


def merge_plays(*parts: DataFrame) -> DataFrame:
    """Sum of several (user_id, recording_id, plays) tables, saturating."""
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.groupBy("user_id", "recording_id").agg(V.saturated(F.sum("plays").cast("long")).alias("plays"))


def surrogate_keys(keys: DataFrame, column: str = "mbid", first: int = 0) -> DataFrame:
    """(recording_id, column): dense numbers from ``first`` in the order of distinct keys, whatever keys look like."""
    return numbered(keys.select(column).distinct(), column, name="recording_id", first=first).select("recording_id", column)


def extend_keys(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """``held`` plus numbers above its largest for keys it lacks; an empty table starts at 1."""
    new = surrogate_keys(fresh.join(held, "mbid", "left_anti"), first=0)
    largest = held.agg(F.coalesce(F.max("recording_id"), F.lit(0)).alias("largest"))  # one row
    return held.select("recording_id", "mbid").unionByName(new.crossJoin(F.broadcast(largest)).select((F.col("recording_id") + F.col("largest") + 1).alias("recording_id"), "mbid"))


def artist_bridge(listens: DataFrame, recording: DataFrame) -> DataFrame:
    """Distinct (recording_id, artist_mbid); recordings without credits have no row."""
    credits = listens.where("recording_mbid IS NOT NULL AND artist_credit_mbids IS NOT NULL").select(F.col("recording_mbid").alias("mbid"), F.explode("artist_credit_mbids").alias("artist_mbid")).distinct()
    return credits.join(recording, "mbid").select("recording_id", "artist_mbid").distinct()


def declared_overlap(library: DataFrame, declared: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` users with most declared recordings (user_id, n); ties to the smaller id."""
    return library.join(declared.select("mbid"), "mbid", "left_semi").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(k)


def own_user(library: DataFrame, declared: DataFrame, known: int | None = None) -> DataFrame:
    """One row (own, coverage, runner_up): the user whose library the declaration is.

    ``own`` is the top user if it holds half of the declaration and half as much again as the next one,
    otherwise ``known``, otherwise null.
    """
    top = declared_overlap(library, declared)
    size = declared.agg(F.countDistinct("mbid").alias("size"))
    ranked = top.agg(F.max(F.struct("n", (-F.col("user_id")).alias("minus"))).alias("best"), F.when(F.count("*") > 1, F.min("n")).otherwise(0).alias("runner_up"))
    row = ranked.crossJoin(size)
    coverage = F.floor(F.col("best.n") * 100 / F.col("size"))
    clear = (coverage >= S.OWN_COVERAGE_PERCENT) & (F.col("best.n") * 100 >= F.col("runner_up") * S.OWN_MARGIN_PERCENT)
    return row.select(F.when(clear, -F.col("best.minus")).otherwise(F.lit(known).cast("long")).alias("own"), coverage.cast("long").alias("coverage"), F.col("runner_up").cast("long").alias("runner_up"))


def pool(library: DataFrame, own: DataFrame) -> DataFrame:
    """Users, without the own one, that have played enough recordings often enough."""
    repeated = library.where(F.col("plays") >= S.MIN_PLAYS).groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= S.MIN_REPEATED)
    return repeated.join(F.broadcast(own.select("own")), F.col("user_id") == F.col("own"), "left_anti").select("user_id")


def user_plays(library: DataFrame, recording: DataFrame, members: DataFrame, key: str = "mbid") -> DataFrame:
    """The fact table (user_id, recording_id, plays) of the pool's users; ``key`` is what names a recording in both.

    Numbers come first: names, which are longer, are shuffled once, and rows end up beside others of their user.
    ``library`` is a table, so that its rows are counted without being read.
    """
    rows = library.count()
    held, ids = dealt(library, rows, key), dealt(recording.select(key, "recording_id"), rows, key)
    return of_members(held.join(ids, key), members)


def of_members(plays: DataFrame, members: DataFrame) -> DataFrame:
    return plays.join(members.select("user_id"), "user_id", "left_semi").select("user_id", "recording_id", "plays")


def occurrence(plays: DataFrame) -> DataFrame:
    """(user_id, plays, recording): how many recordings a user has played so often."""
    return plays.groupBy("user_id", "plays").agg(F.count("*").alias("recording"))


def running_listens(histogram: DataFrame) -> DataFrame:
    """(user_id, x, reached, recording, heard): running plays by log plays, and the user's totals."""
    user = Window.partitionBy("user_id")
    upto = user.orderBy("plays").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("plays").cast("long") * F.col("recording")
    return histogram.select("user_id", F.log(F.greatest("plays", F.lit(1))).alias("x"), F.sum(mass).over(upto).alias("reached"), F.sum("recording").over(user).alias("recording"), F.sum(mass).over(user).alias("heard"))


def user_stat(plays: DataFrame) -> DataFrame:
    """(user_id, center, low, high, recording): play-weighted lower quantiles of log plays.

    The least x whose running plays reach the share; interpolating percentiles would give other values.
    Plays are dealt by users once, which serves the counts, the running sums and the quantiles.  ``plays`` is a table.
    """
    by_user = dealt(plays.select("user_id", "plays"), plays.count(), "user_id")
    reaches = lambda p: F.min(F.when(F.col("reached") >= p * F.col("heard"), F.col("x")))
    return running_listens(occurrence(by_user)).groupBy("user_id").agg(reaches(S.CENTER).alias("center"), reaches(S.LOW).alias("low"), reaches(S.HIGH).alias("high"), F.max("recording").alias("recording"))


def recording_listener(plays: DataFrame) -> DataFrame:
    return plays.groupBy("recording_id").agg(F.count("*").alias("listener"), F.sum(F.col("plays").cast("long")).alias("plays"))


def symmetric_links(links: DataFrame) -> DataFrame:
    """(artist_mbid, related_mbid) in both directions, each once."""
    return links.unionByName(links.select(F.col("related_mbid").alias("artist_mbid"), F.col("artist_mbid").alias("related_mbid"))).distinct()


def artist_links(link: DataFrame, artist: DataFrame) -> DataFrame:
    """Edges between artists' public ids from link rows (entity0, entity1) and artists (id, gid)."""
    a, b = artist.alias("a"), artist.alias("b")
    named = link.join(a, F.col("entity0") == F.col("a.id")).join(b, F.col("entity1") == F.col("b.id"))
    return symmetric_links(named.select(F.col("a.gid").alias("artist_mbid"), F.col("b.gid").alias("related_mbid")))
