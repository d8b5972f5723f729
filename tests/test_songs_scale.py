"""Songs that share a title: as many pairs as the match asks for, but spread over tasks, and none where only songs are asked for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.operators import outliers as O


def _copies(spark, n, prefix):
    return O.songs(spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("mbid"), F.lit("One Song").alias("title"), F.lit("Band").alias("artist"), F.col("id").alias("heard")))


def _per_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("level", [O.EXACT, O.STRIPPED])
def test_pairs_of_one_title_are_spread_over_tasks(spark, level):
    listened = _copies(spark, 3000, "l") if level == O.EXACT else O.songs(_copies(spark, 3000, "l").select("mbid", F.lit("One Song (Live)").alias("title"), "artist", "heard"))
    matches = O.title_matches(_copies(spark, 3000, "d"), listened, level)
    assert matches.distinct().count() == 9_000_000
    shares = _per_task(matches)
    assert sum(shares) == 9_000_000 and max(shares) < 6_000_000
    assert O.title_matches(_copies(spark, 30, "d"), listened, O.EXACT + O.STRIPPED - level).isEmpty()


def test_assigned_pairs_of_one_title_are_spread_over_tasks(spark):
    assigned = O.assign(_copies(spark, 3000, "d"), _copies(spark, 3000, "l"))
    shares = _per_task(assigned)
    assert sum(shares) == 9_000_000 and max(shares) < 6_000_000


def test_the_undeclared_are_found_without_pairs(spark):
    """A million copies on either side would be 1e12 pairs."""
    declared, listened = _copies(spark, 1_000_000, "d"), _copies(spark, 1_000_000, "l")
    other = listened.limit(3).withColumns({"mbid": F.concat(F.lit("x"), "mbid"), "title": F.lit("Another"), "exact_key": F.lit("another"), "stripped_key": F.lit("another")})
    left = O.undeclared(listened.unionByName(other), O.assigned_once(declared, listened.unionByName(other)))
    assert {r["title"] for r in left.select("title").collect()} == {"Another"}
