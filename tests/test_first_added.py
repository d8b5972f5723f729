"""The dates of first additions, through replacements, against reading the log line by line."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from cadenza import registry
from cadenza.operators import outliers as O

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def read_through(log):
    dates, removed, at_commit, inherited = {}, [], None, 0
    for commit, at, _, sign, mbid, rest in sorted(log, key=lambda r: (r[0], r[2], r[3] == "+", r[4])):
        if commit != at_commit:
            at_commit, removed = commit, []
        if sign == "-":
            removed.append((rest, mbid))
            continue
        k = next((k for k, (r, _) in enumerate(removed) if r == rest), None)
        old = None if k is None else removed.pop(k)[1]
        inherited += mbid not in dates and old in dates
        dates.setdefault(mbid, dates.get(old, at))
    return dates, inherited


def test_chains_circles_and_order_of_lines(spark):
    rng = random.Random(3)
    log = [(c, c * 10, n, rng.choice("+-"), f"m{rng.randrange(c + 2)}", f"q{rng.randrange(2)}") for c in range(1, 60) for n in range(6)]
    # Three ids replace each other in a circle, and a long chain follows.
    log += [(100 + c, 1000 + c, n, s, m, "x") for c, (r, a) in enumerate([("u", "v"), ("v", "w"), ("w", "u")]) for n, s, m in ((1, "-", r), (2, "+", a))]
    log += [(200, 2000, 1, "+", "c0", "y")] + [(200 + k, 2000 + k, n, s, m, "y") for k in range(1, 12) for n, s, m in ((1, "-", f"c{k - 1}"), (2, "+", f"c{k}"))]
    frame = spark.createDataFrame(log, "commit long, at long, line long, sign string, mbid string, rest string")
    want, inherited = read_through(log)
    assert inherited > 11 and want["c11"] == 2000
    assert {r["mbid"]: r["at"] for r in O.first_added(frame).collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_query_reads_the_whole_log(spark):
    lines, orders = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("lineitem", "orders"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_suppkey").collect()
    log = [(o, o * 1000, n * 100000 + p, "-" if flag == "R" else "+", f"e{p}", f"q{s % 3}") for o, n, p, flag, s in rows]
    want, inherited = read_through(log)
    assert inherited > 0
    assert {r["mbid"]: r["at"] for r in registry.queries()["win_first_added"](spark, DATA).collect()} == want
