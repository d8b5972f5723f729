"""Redirects: long chains, circles and ways into them, against a plain loop."""

from __future__ import annotations

import random

from cadenza.operators.sync import chase


def plain(start, target):
    out = {}
    for s in start:
        at, seen = s, {s}
        while at in target and target[at] not in seen:
            at = target[at]
            seen.add(at)
        out[s] = at
    return out


def chased(spark, start, target):
    rows = chase(spark.createDataFrame([(s,) for s in start], "id long"), spark.createDataFrame(list(target.items()), "id long, target long")).collect()
    assert len(rows) == len(start)
    return {r["id"]: r["live"] for r in rows}


def test_a_chain_of_ten_thousand(spark):
    target = {i: i + 1 for i in range(10_000)}
    assert chased(spark, [0, 1, 9_999, 10_000, 20_000], target) == {0: 10_000, 1: 10_000, 9_999: 10_000, 10_000: 10_000, 20_000: 20_000}


def test_circles_and_ways_into_them(spark):
    rnd = random.Random(4)
    target = {i: rnd.randrange(400) for i in range(300)}  # 300 to 399 are ends
    target |= {500: 500, 501: 502, 502: 501, 600: 601} | {i: i + 1 for i in range(601, 650)} | {650: 640}
    start = [*range(420), 500, 501, 502, *range(600, 651)]
    assert chased(spark, start, target) == plain(start, target)


def test_only_circles_and_nothing_at_all(spark):
    assert chased(spark, [1, 2, 3], {1: 2, 2: 3, 3: 1}) == {1: 3, 2: 1, 3: 2}
    assert chased(spark, [7], {}) == {7: 7}
