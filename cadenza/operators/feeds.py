"""Feeds: ordered rows (feed, position, mbid, latest_listened_at) merged into one stream of recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.ordered import numbered


def positions(rows: DataFrame, *order: Column | str, by: str | None = None) -> DataFrame:
    """Positions from 0 in the given order, within ``by`` or over all rows."""
    return numbered(rows, *order, name="position", by=(by,) if by else ())


def interleave(feeds: DataFrame) -> DataFrame:
    """One row of each living feed per turn: the order is (position, feed), and every row read has an index."""
    return numbered(feeds, "position", "feed", first=1)


def unlistened(rows: DataFrame, only: bool = True) -> DataFrame:
    return rows.where(F.col("latest_listened_at").isNull()) if only else rows


def first_shown(rows: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Each key where it comes first, without those of ``skip``."""
    if skip is not None:
        rows = rows.join(skip.select("mbid").distinct(), "mbid", "left_anti")
    turn = F.row_number().over(Window.partitionBy("mbid").orderBy("index"))
    return rows.withColumn("turn", turn).where("turn = 1").drop("turn")


def merged(feeds: DataFrame, skip: DataFrame, only_unlistened: bool = False) -> DataFrame:
    """Indexes are given before the unlistened filter, and that filter comes before keys count as shown."""
    return first_shown(unlistened(interleave(feeds), only_unlistened), skip)


def island_turns(candidates: DataFrame, rank: DataFrame, skip: DataFrame) -> DataFrame:
    """One candidate per living island and turn, islands by rank; skipped keys take no turn."""
    fresh = candidates.join(skip.select("mbid").distinct(), "mbid", "left_anti")
    turns = numbered(fresh, "position", name="turn", first=1, by=("island",)).join(rank, "island")
    return numbered(turns, "turn", "rank", first=1)


def by_popularity(rows: DataFrame) -> DataFrame:
    return positions(rows.where("heard > 0"), F.desc("heard"), "mbid")


def by_newest(rows: DataFrame) -> DataFrame:
    return positions(rows, F.desc_nulls_last("released"), F.desc("heard"), "mbid")


def weeks(playlists: DataFrame, k: int = 2) -> DataFrame:
    """The latest ``k`` playlists by week."""
    return playlists.orderBy(F.desc("week"), "mbid").limit(k)
