"""The similarity join, medians and numbers within keys, against plain loops."""

from __future__ import annotations

import math
import random
import statistics
from collections import defaultdict

import pytest

from cadenza.operators import islands, similarity
from cadenza.operators.ordered import median, numbered


def heard(spark, pairs):
    return spark.createDataFrame(pairs, "mbid string, user_id long")


def plain(pairs, threshold):
    sets = defaultdict(set)
    for mbid, user in pairs:
        sets[mbid].add(user)
    names, out = sorted(sets), {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared / math.sqrt(len(sets[a]) * len(sets[b])) >= threshold:
                out[a, b] = shared
    return out


@pytest.mark.parametrize("threshold", [0.05, 0.15, 0.5, 0.8, 1.0])
def test_similar_audiences_against_all_pairs(spark, threshold):
    rnd = random.Random(int(threshold * 100))
    pairs = [(f"m{int(60 * rnd.random() ** 2)}", int(200 * rnd.random() ** 3)) for _ in range(2500)]
    pairs += [(f"e{i}", u) for i in range(4) for u in range(500, 507)] + pairs[:100]  # equal sets, repeated rows
    got = {(r["a"], r["b"]): r["shared"] for r in similarity.similar(heard(spark, pairs), threshold).collect()}
    assert got == plain(pairs, threshold) and got


def test_similar_gives_the_pairs_of_cosine(spark):
    rnd = random.Random(1)
    rows = heard(spark, [(f"m{rnd.randrange(40)}", rnd.randrange(60)) for _ in range(700)])
    some = {(r["a"], r["b"], r["shared"], r["cosine"]) for r in similarity.similar(rows, 0.3).collect()}
    assert some == {(r["a"], r["b"], r["shared"], r["cosine"]) for r in islands.cosine(rows).where("cosine >= 0.3").collect()}


def test_a_user_of_very_many_recordings_makes_few_pairs(spark):
    """One user has declared all of 20,000 recordings, whose other nine listeners share little: 2e8 pairs of one common listener."""
    count = 20_000
    every = spark.range(count).selectExpr("concat('m', id) AS mbid", "0L AS user_id")
    others = spark.range(count).selectExpr("concat('m', id) AS mbid", "explode(sequence(1, 9)) AS k", "id").selectExpr("mbid", "id * 10 + k AS user_id")
    twins = spark.range(0, count, 100).selectExpr("concat('m', id + 1) AS mbid", "explode(sequence(1, 9)) AS k", "id").selectExpr("mbid", "id * 10 + k AS user_id")
    rows = every.unionByName(others).unionByName(twins)
    sets = similarity.ranked_sets(rows)
    assert similarity.candidates(sets, 0.15).count() < 2 * count
    got = {(r["a"], r["b"]): r["shared"] for r in similarity.similar(rows, 0.15).collect()}
    assert got == {tuple(sorted((f"m{i}", f"m{i + 1}"))): 10 for i in range(0, count, 100)}


def test_no_audience_no_pairs(spark):
    assert similarity.similar(heard(spark, []), 0.2).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        similarity.similar(heard(spark, []), 0.0)


def test_medians_against_sorted_lists(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1.5, 2.0, rnd.random() * 9])) for _ in range(900)] + [("c", 4.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    rows += [("hot", float(i % 700)) for i in range(5000)]
    of = defaultdict(list)
    for key, value in rows:
        if value is not None:
            of[key].append(value)
    df = spark.createDataFrame(rows, "q string, rate double")
    assert {r["q"]: r["median"] for r in median(df, "rate", ("q",)).collect()} == {k: statistics.median(v) for k, v in of.items()}
    assert median(df, "rate").first()["median"] == statistics.median([v for some in of.values() for v in some])
    assert median(df.limit(0), "rate").first()["median"] is None and median(df.limit(0), "rate", ("q",)).count() == 0


def test_a_key_that_spans_ranges_is_numbered_throughout(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), i) for i in range(3000)]
    rnd.shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "k string, v long").repartition(7), "v", by=("k",), first=1).collect()
    want = {}
    for key in {k for k, _ in rows}:
        want |= {(key, v): n for n, v in enumerate(sorted(v for k, v in rows if k == key), 1)}
    assert {(r["k"], r["v"]): r["index"] for r in got} == want and len(got) == len(rows)
