"""Exact similarity join of audiences: pairs of recordings whose cosine reaches a threshold, without all pairs.

Listeners are ordered by rarity, those of fewest recordings first.  For the cosine of two sets to reach ``t``, the
smaller one of n must share at least t * n elements, and a larger one of m at least t * t * m; so the two meet in
what stands before their last ceil(t * n) - 1 and ceil(t * t * m) - 1 elements.  Only these prefixes are joined, and
there only sets whose sizes and places leave enough to share.  The listeners of most recordings stand last in
every set: they make hardly any pairs.  Candidates are then verified by packed bitmaps: 64 neighbouring listeners are
the bits of a number, and the numbers of two recordings are AND-ed and their bits counted.

Sets too small to share less than all they have (t * n <= 1) are prefixes as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ordered import numbered
from cadenza.sources.sinks import staged

#: Bounds are loosened by this much, so that rounding drops no pair; what is kept is decided by the exact count.
_SLACK = 1e-9
_WORD = 64


def _at_least(share: Column) -> Column:
    """The least whole number of common elements that a real bound asks for."""
    return F.greatest(F.ceil(share - _SLACK), F.lit(1)).cast("long")


def ranked_sets(heard: DataFrame) -> DataFrame:
    """(mbid, user, n, place): each recording's listeners, named by their rank in rarity, with the set's size and their place in it."""
    who = staged(heard.select("mbid", "user_id").distinct(), "who")
    users = numbered(who.groupBy("user_id").agg(F.count("*").alias("degree")), "degree", "user_id", name="user")
    size = who.groupBy("mbid").agg(F.count("*").alias("n"))
    ranked = who.join(users.select("user_id", "user"), "user_id").select("mbid", "user")
    return numbered(ranked, "user", name="place", first=1, by=("mbid",)).join(size, "mbid")


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(x, y, n_x, n_y): pairs, the smaller set first, that may reach the threshold."""
    small = sets.where(F.col("place") <= F.col("n") - _at_least(F.col("n") * threshold) + 1)
    large = sets.where(F.col("place") <= F.col("n") - _at_least(F.col("n") * threshold * threshold) + 1)
    x, y = small.alias("x"), large.alias("y")
    needed = F.sqrt(F.col("x.n").cast("double") * F.col("y.n")) * threshold - _SLACK
    # Before a common element stand at most so many others, and after it.
    most = F.least("x.place", "y.place") + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met = x.join(y, (F.col("x.user") == F.col("y.user")) & (F.struct("x.n", "x.mbid") < F.struct("y.n", "y.mbid")) & (F.col("x.n") >= needed) & (most >= needed))
    return met.select(F.col("x.mbid").alias("x"), F.col("y.mbid").alias("y"), F.col("x.n").alias("n_x"), F.col("y.n").alias("n_y")).distinct()


def packed(sets: DataFrame) -> DataFrame:
    """(mbid, word, bits): listeners as bits, 64 neighbours in rarity a number."""
    word = F.call_function("div", F.col("user"), F.lit(_WORD)).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("user") % _WORD).cast("int"))
    return sets.select("mbid", word, bit.alias("bit")).groupBy("mbid", "word").agg(F.bit_or("bit").alias("bits"))


def similar(heard: DataFrame, threshold: float) -> DataFrame:
    """(a, b, shared, cosine) of the pairs whose audiences' cosine is ``threshold`` or more, a before b.

    Equal to all pairs of :func:`cadenza.operators.islands.cosine` at or above it.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold: {threshold!r}")
    sets = staged(ranked_sets(heard), "sets")
    pairs = candidates(sets, threshold)
    bits = staged(packed(sets), "bits")
    mine = pairs.join(bits.select(F.col("mbid").alias("x"), "word", F.col("bits").alias("x_bits")), "x")
    both = mine.join(bits.select(F.col("mbid").alias("y"), "word", F.col("bits").alias("y_bits")), ["y", "word"])
    shared = both.groupBy("x", "y", "n_x", "n_y").agg(F.sum(F.bit_count(F.col("x_bits").bitwiseAND(F.col("y_bits")))).alias("shared"))
    cosine = F.col("shared") / F.sqrt(F.col("n_x") * F.col("n_y"))
    return shared.withColumn("cosine", cosine).where(F.col("cosine") >= threshold).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "cosine")
