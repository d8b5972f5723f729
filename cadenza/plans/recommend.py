"""The island recommendation, from an index and a declaration to ranked candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza import schema as S
from cadenza.operators import islands as I
from cadenza.operators.similarity import similar
from cadenza.sources.sinks import staged


def candidates(parts: dict[str, DataFrame], declared: DataFrame, members: DataFrame, damp: float = S.POPULARITY_DAMP, least: int = S.MIN_BACKERS, k: int = S.PER_ISLAND) -> DataFrame:
    """(island, position, mbid, score, backer, listener, plays) for given cohorts (island, user_id, weight)."""
    vote = I.votes(parts["user_plays"], parts["user_stat"], members)
    known = I.known_artists(declared, parts["recording"], parts["recording_artist"], parts["artist_link"])
    fit = I.eligible(I.backing(vote), parts["recording"], parts["recording_listener"], declared, parts["recording_artist"], known, least)
    return I.ranked(I.best_of_artist(I.per_artist(I.scored(fit, damp), parts["recording_artist"])), k)


def recommend(parts: dict[str, DataFrame], declared: DataFrame, threshold: float = S.SIMILARITY, granularity: float = S.GRANULARITY, community: int = S.MIN_COMMUNITY, damp: float = S.POPULARITY_DAMP) -> DataFrame:
    """Everything: audiences, communities, cohorts and their candidates."""
    heard = staged(I.audience(parts["user_plays"], parts["user_stat"], parts["recording"], declared), "heard")
    supported = heard.select("mbid").distinct()
    edge = similar(heard, threshold).select("a", "b", F.col("cosine").alias("weight"))
    island = I.communities(lambda loose: I.cosine(heard, loose), supported, threshold, granularity, community, edge)
    return candidates(parts, declared, I.cohort(I.affinity(heard, island)), damp)


#: What each source may feed: (source, feed, needs the index).
ROUTES = [
    ("all", "island", True), ("all", "collaborative_filtering", False), ("all", "play_count", False), ("all", "weekly_exploration", False),
    ("island", "island", True), ("collaborative_filtering", "collaborative_filtering", False), ("play_count", "play_count", False), ("weekly_exploration", "weekly_exploration", False),
]


def validate(source: str, target: str | None = None, damp: float = S.POPULARITY_DAMP, granularity: float = S.GRANULARITY, island: str | None = None, seeds: tuple = (), genres: tuple = (), sort: str = "popularity", target_is_artist: bool = False) -> None:
    """The rules between options."""
    if damp < 0:
        raise ValueError("popularity damp must not be negative")
    if granularity <= 0:
        raise ValueError("granularity must be positive")
    if island and (seeds or genres):
        raise ValueError("island excludes seeds and genres")
    if source == "island" and target:
        raise ValueError("the island source takes no target")
    if sort == "newest" and not target_is_artist:
        raise ValueError("newest needs an artist")
