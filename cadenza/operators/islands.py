"""Islands of taste: audiences, similarity, communities, cohorts and candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza import schema as S
from cadenza.functions import attraction as A
from cadenza.functions import values as V
from cadenza.operators.ordered import median, numbered
from cadenza.sources.sinks import staged

#: A declaration is written by hand; communities are found among at most so many recordings.
MAX_DECLARED = 20_000


def audience(plays: DataFrame, stat: DataFrame, recording: DataFrame, declared: DataFrame) -> DataFrame:
    """(mbid, q, user_id, weight): who listens to the declared recordings, and how drawn they are.

    The declared recordings are few, so the fact table is reduced to theirs before any shuffle: their numbers are
    written down, since Spark takes the size of a join for the product of what it joins.
    """
    ids = staged(declared.join(recording, "mbid").select("mbid", "q", "recording_id"), "declared")
    heard = plays.join(ids, "recording_id").join(stat, "user_id")
    return heard.select("mbid", "q", "user_id", A.weight(F.col("plays"), F.col("center"), F.col("low"), F.col("high")).alias("weight"))


def audience_idf(heard: DataFrame) -> DataFrame:
    """(mbid, listeners, idf): log of users with any declared recording over those with this one."""
    users = heard.agg(F.countDistinct("user_id").alias("users"))
    return heard.groupBy("mbid").agg(F.count("*").alias("listeners")).crossJoin(F.broadcast(users)).select("mbid", "listeners", F.log(F.col("users") / F.col("listeners")).alias("idf"))


def cosine(heard: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, cosine): similarity of binary audiences of each pair with a common listener, a before b.

    The pairs come from equal users, never from a cross join; a user makes pairs of declared recordings only.  With
    ``only`` (mbid) these are the pairs that hold one of its recordings.  Pairs at or above a threshold alone are
    found by :func:`cadenza.operators.similarity.similar`, which does not make the others.
    """
    who = heard.select("mbid", "user_id").distinct()
    size = who.groupBy("mbid").agg(F.count("*").alias("n"))
    if only is None:
        x, y, once = who, who, F.col("x.mbid") < F.col("y.mbid")
    else:
        wanted = only.select("mbid").distinct()
        x, y = who.join(wanted, "mbid", "left_semi"), who.join(wanted.withColumn("wanted", F.lit(True)), "mbid", "left")
        once = (F.col("x.mbid") < F.col("y.mbid")) | (F.col("y.wanted").isNull() & (F.col("x.mbid") > F.col("y.mbid")))
    pairs = x.alias("x").join(y.alias("y"), (F.col("x.user_id") == F.col("y.user_id")) & once)
    shared = pairs.groupBy(F.least("x.mbid", "y.mbid").alias("a"), F.greatest("x.mbid", "y.mbid").alias("b")).agg(F.count("*").alias("shared"))
    of = lambda c: size.select(F.col("mbid").alias(c), F.col("n").alias(f"n_{c}"))
    return shared.join(of("a"), "a").join(of("b"), "b").select("a", "b", "shared", (F.col("shared") / F.sqrt(F.col("n_a") * F.col("n_b"))).alias("cosine"))


def edges(similarity: DataFrame, threshold: float = S.SIMILARITY) -> DataFrame:
    return similarity.where(F.col("cosine") >= threshold).select("a", "b", F.col("cosine").alias("weight"))


def contract(edge: DataFrame, community: DataFrame) -> DataFrame:
    """(a, b, weight): edges between communities (node, island); a = b holds what lies inside one."""
    of = lambda c: community.select(F.col("node").alias(c), F.col("island").alias(f"c_{c}"))
    both = edge.join(of("a"), "a").join(of("b"), "b")
    return both.groupBy(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).agg(F.sum("weight").alias("weight"))


def _louvain(n: int, edge: list[tuple[int, int, float]], resolution: float) -> list[int]:
    """Community of each node 0..n-1.  Nodes in order; the best gain must beat staying; ties to the lower label."""
    where = list(range(n))
    neighbours: list[dict[int, float]] = [{} for _ in range(n)]
    degree = [0.0] * n
    for a, b, w in edge:
        neighbours[a][b] = neighbours[a].get(b, 0.0) + w
        neighbours[b][a] = neighbours[b].get(a, 0.0) + w
        degree[a] += w
        degree[b] += w
    while True:
        size, total = len(neighbours), sum(degree)
        label, mass = list(range(size)), degree[:]
        moving = total > 0
        for _ in range(1000):
            if not moving:
                break
            moving = False
            for i in range(size):
                home = label[i]
                mass[home] -= degree[i]
                pull: dict[int, float] = {home: 0.0}
                for j, w in neighbours[i].items():
                    if j != i:
                        pull[label[j]] = pull.get(label[j], 0.0) + w
                gains = {c: s - resolution * degree[i] * mass[c] / total for c, s in pull.items()}
                best = min(gains, key=lambda c: (-gains[c], c))
                if gains[best] <= gains[home]:
                    best = home
                label[i] = best
                mass[best] += degree[i]
                moving |= best != home
        names: dict[int, int] = {}
        dense = [names.setdefault(c, len(names)) for c in label]
        if len(names) == size:
            return where
        where = [dense[c] for c in where]
        merged: list[dict[int, float]] = [{} for _ in names]
        degrees = [0.0] * len(names)
        for i, near in enumerate(neighbours):
            degrees[dense[i]] += degree[i]
            for j, w in near.items():
                if dense[i] != dense[j]:
                    merged[dense[i]][dense[j]] = merged[dense[i]].get(dense[j], 0.0) + w
        neighbours, degree = merged, degrees


def _absorb_small(label: list[int], alike: list[dict[int, float]], least: int) -> list[int]:
    """Dissolve the smallest community below ``least`` until none is left: members go to their most similar peer's."""
    label = label[:]
    while True:
        sizes: dict[int, int] = {}
        for c in label:
            sizes[c] = sizes.get(c, 0) + 1
        small = [c for c in sizes if sizes[c] < least]
        if len(sizes) < 2 or not small:
            return label
        gone = min(small, key=lambda c: (sizes[c], c))
        biggest = min((c for c in sizes if c != gone), key=lambda c: (-sizes[c], c))
        for i in [i for i, c in enumerate(label) if c == gone]:
            peers = [(-w, j) for j, w in alike[i].items() if label[j] != gone and w > 0]
            label[i] = label[min(peers)[1]] if peers else biggest


def communities(
    similarity: DataFrame | Callable[[DataFrame], DataFrame], nodes: DataFrame, threshold: float = S.SIMILARITY, granularity: float = S.GRANULARITY, least: int = 1, edge: DataFrame | None = None
) -> DataFrame:
    """(mbid, island): Louvain communities of the similarity graph, small ones absorbed if ``least`` > 1.

    ``edge`` (a, b, weight) are the pairs at or above the threshold; without it they are taken from ``similarity``.
    That is all pairs (a, b, cosine), or a function that makes those pairs that hold one of given recordings: it is
    called only for members of communities that are too small.

    Louvain moves one node after another, so the graph of one declaration (at most ``MAX_DECLARED``
    recordings, which is checked) is one group in one task; several declarations would be several groups.
    What goes there are numbers: edges and, for absorbing, the ``least`` most similar peers of each member of a small
    community.  A community that is dissolved has fewer than ``least`` members, so if a member has any
    peer outside it, the best of them is among these.
    """
    import pandas as pd

    if granularity <= 0:
        raise ValueError("granularity must be positive")
    if (n := nodes.count()) > MAX_DECLARED:
        raise ValueError(f"{n} declared recordings, {MAX_DECLARED} at most")
    if edge is None:
        edge = edges(similarity, threshold)
    named = staged(numbered(nodes.select("mbid").distinct(), "mbid", name="node"), "nodes")

    def in_numbers(pairs: DataFrame, weight: str) -> DataFrame:
        of = lambda c: named.select(F.col("mbid").alias(c), F.col("node").alias(f"n_{c}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b"), F.col(weight).alias("weight"))

    own = named.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("weight"))

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        linked = rows[rows["b"].notna()].sort_values(["a", "b"])
        size = int(rows["b"].isna().sum())
        label = _louvain(size, [(int(a), int(b), w) for a, b, w in zip(linked["a"], linked["b"], linked["weight"], strict=True)], granularity)
        return pd.DataFrame({"node": range(size), "island": label})

    found = own.unionByName(in_numbers(edge, "weight")).groupBy(F.lit("declaration")).applyInPandas(find, "node long, island long")
    if least > 1:
        found = staged(found, "communities")
        small = found.join(found.groupBy("island").agg(F.count("*").alias("n")).where(F.col("n") < least), "island")
        loose = staged(small.join(named, "node").select("node", "mbid"), "loose")
        pairs = in_numbers(similarity(loose) if callable(similarity) else similarity, "cosine").where("weight > 0")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).join(loose.select(F.col("node").alias("a")), "a", "left_semi")
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
        peers = both.withColumn("rank", rank).where(F.col("rank") <= least).select("a", "b", "weight")

        def absorb(rows: pd.DataFrame) -> pd.DataFrame:
            given = rows[rows["weight"].isna()].sort_values("a")
            alike: list[dict[int, float]] = [{} for _ in range(len(given))]
            near = rows[rows["weight"].notna()]
            for a, b, w in zip(near["a"], near["b"], near["weight"], strict=True):
                alike[int(a)][int(b)] = w
            return pd.DataFrame({"node": range(len(given)), "island": _absorb_small([int(c) for c in given["b"]], alike, least)})

        labels = found.select(F.col("node").alias("a"), F.col("island").alias("b"), F.lit(None).cast("double").alias("weight"))
        found = labels.unionByName(peers).groupBy(F.lit("declaration")).applyInPandas(absorb, "node long, island long")
    found = staged(found, "communities")
    # Islands are numbered in the order of their first members: there are as many as communities.
    first = numbered(found.groupBy("island").agg(F.min("node").alias("first")), "first", name="place")
    return found.join(first, "island").join(named, "node").select("mbid", F.col("place").alias("island"))


def affinity(heard: DataFrame, island: DataFrame) -> DataFrame:
    """(island, user_id, weight): how much each user shares an island's taste.

    A seed pulls by its declared weight and rarity; shared dislike pulls nobody.
    """
    seed = V.q_weight(F.col("q")) * F.col("idf")
    pulled = F.when((F.col("seed") < 0) & (F.col("weight") < 0), 0.0).otherwise(F.col("seed") * F.col("weight"))
    seeds = heard.join(audience_idf(heard), "mbid").withColumn("seed", seed).where("seed <> 0")
    return seeds.join(island, "mbid").groupBy("island", "user_id").agg(F.sum(pulled).alias("weight"))


def cohort(shared: DataFrame, size: int = S.COHORT_SIZE) -> DataFrame:
    """The ``size`` users of each island with the most affinity above zero; ties to the smaller id.

    Affinities are sums of fractions, whose last digits depend on the order of summation: they are compared by nine digits.
    """
    rank = F.row_number().over(Window.partitionBy("island").orderBy(F.desc(F.round("weight", 9)), "user_id"))
    return shared.where("weight > 0").withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")


def known_artists(declared: DataFrame, recording: DataFrame, bridge: DataFrame, link: DataFrame) -> DataFrame:
    """Artists of declared recordings and those one link away."""
    own = bridge.join(recording.join(declared, "mbid", "left_semi"), "recording_id", "left_semi").select("artist_mbid").distinct()
    near = link.join(own, "artist_mbid", "left_semi").select(F.col("related_mbid").alias("artist_mbid"))
    return own.unionByName(near).distinct()


def votes(plays: DataFrame, stat: DataFrame, members: DataFrame) -> DataFrame:
    """(recording_id, island, cohort_weight, attraction, breadth): what each cohort member's plays say.

    Cohorts hold at most ``COHORT_SIZE`` users per island; where they are as small as that mostly makes them, Spark
    broadcasts them, and the fact table is read once without a shuffle.  It knows their size as they are written down.
    """
    usual = median(stat, "recording", name="usual")
    of = staged(members.withColumnRenamed("weight", "cohort_weight").join(stat, "user_id").crossJoin(F.broadcast(usual)), "members")
    voted = plays.join(of, "user_id")
    drawn = A.weight(F.col("plays"), F.col("center"), F.col("low"), F.col("high"))
    return voted.select("recording_id", "island", "cohort_weight", drawn.alias("attraction"), V.breadth(F.col("recording"), F.col("usual")).alias("breadth"))


def backing(vote: DataFrame) -> DataFrame:
    return vote.groupBy("recording_id", "island").agg(F.sum(F.col("cohort_weight") * F.col("attraction") / F.col("breadth")).alias("weight"), F.count_if(F.col("attraction") > 0).alias("backer"))


def eligible(backed: DataFrame, recording: DataFrame, listener: DataFrame, declared: DataFrame, bridge: DataFrame, known: DataFrame, least: int = S.MIN_BACKERS) -> DataFrame:
    """Backed recordings that are neither declared nor by a known artist."""
    enough = backed.where((F.col("backer") >= least) & (F.col("weight") > 0))
    named = enough.join(recording, "recording_id").join(declared, "mbid", "left_anti")
    by_known = bridge.join(known, "artist_mbid", "left_semi").select("recording_id")
    return named.join(by_known, "recording_id", "left_anti").join(listener, "recording_id")


def scored(candidate: DataFrame, damp: float = S.POPULARITY_DAMP) -> DataFrame:
    if damp < 0:
        raise ValueError("popularity damp must not be negative")
    return candidate.withColumn("score", V.damped(F.col("weight"), F.col("listener"), damp))


def per_artist(candidate: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row per candidate and artist with its rank among that artist's candidates on all islands."""
    rank = F.row_number().over(Window.partitionBy("artist_mbid").orderBy(F.desc("score"), "mbid", "island"))
    return candidate.join(bridge, "recording_id").withColumn("rank", rank)


def best_of_artist(ranked: DataFrame) -> DataFrame:
    """Candidates that are the best one of every one of their artists."""
    return ranked.groupBy("island", "mbid", "backer", "listener", "plays", "score").agg(F.max("rank").alias("worst")).where("worst = 1").drop("worst")


def ranked(best: DataFrame, k: int = S.PER_ISLAND) -> DataFrame:
    position = F.row_number().over(Window.partitionBy("island").orderBy(F.desc("score"), "mbid"))
    return best.withColumn("position", position).where(F.col("position") <= k)


def token_lift(island: DataFrame, genre: DataFrame) -> DataFrame:
    """(island, token, n, lift): tokens over-represented on an island; genre is (mbid, token), one row each."""
    tagged = genre.select("mbid").distinct()
    library = genre.groupBy("token").agg(F.count("*").alias("overall")).crossJoin(F.broadcast(tagged.agg(F.count("*").alias("tagged"))))
    size = island.join(tagged, "mbid", "left_semi").groupBy("island").agg(F.count("*").alias("size"))
    counts = island.join(genre, "mbid").groupBy("island", "token").agg(F.count("*").alias("n")).where(F.col("n") >= S.MIN_TOKEN_COUNT)
    share = F.col("n") / F.col("size")
    lifted = counts.join(size, "island").join(library, "token").withColumn("share", share).where(F.col("share") >= S.MIN_TOKEN_SHARE)
    return lifted.select("island", "token", "n", (F.col("share") / (F.col("overall") / F.col("tagged"))).alias("lift"))


def names(lifted: DataFrame, island: DataFrame) -> DataFrame:
    """(island, name): the three most over-represented tokens, or a number where there are none."""
    rank = F.row_number().over(Window.partitionBy("island").orderBy(F.desc("lift"), F.desc("n"), "token"))
    top = lifted.withColumn("rank", rank).where(F.col("rank") <= S.NAME_TOKENS)
    joined = top.groupBy("island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda t: t["token"]), " / ").alias("name"))
    every = island.select("island").distinct().join(joined, "island", "left")
    return every.select("island", F.coalesce("name", F.concat(F.lit("island "), F.col("island").cast("string"))).alias("name"))


def distinct_names(named: DataFrame) -> DataFrame:
    """A second island of the same name is called `name 2`, and so on."""
    turn = F.row_number().over(Window.partitionBy("name").orderBy("island"))
    return named.withColumn("turn", turn).select("island", F.when(F.col("turn") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" "), F.col("turn").cast("string"))).alias("name"))


def promise(island: DataFrame, declared: DataFrame, members: DataFrame) -> DataFrame:
    """(island, promise) of each island, best first by rank."""
    mean = island.join(declared, "mbid").groupBy("island").agg(F.avg("q").alias("mean_q"))
    library = declared.agg(F.coalesce(F.avg("q"), F.lit(0.0)).alias("library_q"))
    size = members.groupBy("island").agg(F.count("*").alias("size"))
    return mean.join(size, "island", "left").crossJoin(F.broadcast(library)).select("island", V.promise(F.col("mean_q"), F.coalesce("size", F.lit(0)), F.col("library_q")).alias("promise"))


def requested(declared: DataFrame, heard: DataFrame, genre: DataFrame, seeds: list[str], genres: list[str]) -> DataFrame:
    """Members of a requested island: named seeds and recordings of the genres, each once.

    Raises if a seed is not declared or has no audience, or if no recording has a genre.
    """
    spark = declared.sparkSession
    wanted = spark.createDataFrame([(s,) for s in seeds], "mbid string")
    for problem, rows in (("not declared", wanted.join(declared, "mbid", "left_anti")), ("without audience", wanted.join(heard, "mbid", "left_anti"))):
        if missing := [r["mbid"] for r in rows.collect()]:  # at most as many as were asked for
            raise ValueError(f"{problem}: {missing}")
    tokens = [g.strip().lower() for g in genres]
    found = genre.where(F.col("token").isin(tokens))
    if unknown := sorted(set(tokens) - {r["token"] for r in found.select("token").distinct().collect()}):
        raise ValueError(f"unknown genres: {unknown}")
    return wanted.unionByName(found.select("mbid")).distinct().join(heard, "mbid", "left_semi").join(declared.select("mbid"), "mbid", "left_semi").orderBy("mbid")


def pinned(named: DataFrame, needle: str) -> DataFrame:
    return named.where(F.contains(F.col("name"), F.lit(needle.lower())))
