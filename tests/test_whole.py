"""Queries over whole tables against brute force on the driver's smallest tables."""

from __future__ import annotations

import os
from collections import defaultdict

import duckdb
import pytest

from cadenza import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def read(sql):
    connection = duckdb.connect()
    for name in ("part", "orders", "lineitem", "supplier"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection.sql(sql).fetchall()


def got(spark, name):
    return sorted(tuple(row) for row in registry.queries()[name](spark, DATA).collect())


@pytest.fixture(scope="module")
def songs():
    """(assigned, pairs, listened): the match ladder song by song, over all declared parts."""
    parts = read("SELECT p_partkey, p_name, lower(replace(p_brand, '#', '')) FROM part")
    declared = [(f"d{k}", name, artist) for k, name, artist in parts]
    listened = []
    for k, name, artist in parts:
        bare = f"unheard {k}" if k % 6 == 4 else name
        title = bare + {1: " live", 3: " remix"}.get(k % 6, "")
        artists = [[artist], [], [artist, "guest"], ["somebody"]][k % 4]
        listened.append((f"d{k}" if k < 10 else f"l{k}", k, title, bare, artists))
    entries = {d[0] for d in declared}
    assigned, pairs = [], []
    for mbid, _, title, bare, artists in listened:
        if mbid in entries:
            assigned.append((mbid, mbid, 0))
            continue
        own = [(entry, 2 if name == title else 1, not artists or artist in artists) for entry, name, artist in declared if name == bare]
        pairs += [(entry, mbid, level, agree) for entry, level, agree in own]
        agreed = [(level, entry) for entry, level, agree in own if agree]
        exact = [entry for entry, level, _ in own if level == 2]
        if agreed:
            assigned += [(entry, mbid, 1) for level, entry in agreed if level == max(agreed)[0]]
        elif len(exact) == 1 or len(own) == 1:
            assigned.append((exact[0] if len(exact) == 1 else own[0][0], mbid, 2))
    return assigned, pairs, listened


def test_all_parts_are_declared_songs(spark, songs):
    assigned, pairs, listened = songs
    assert got(spark, "join_fuzzy_song") == sorted(assigned)
    assert max(int(entry[1:]) for entry, _, _ in assigned) >= 60
    for level, name in ((2, "song_exact_match"), (1, "song_stripped_match")):
        assert got(spark, name) == sorted((e, m) for e, m, at, agree in pairs if at == level and agree)
    assert got(spark, "song_unique_title") == sorted((e, m) for e, m, step in assigned if step == 2)
    taken = {mbid for _, mbid, _ in assigned}
    left = sorted(((m, n) for m, n, *_ in listened if m not in taken), key=lambda x: (-x[1], x[0]))
    assert got(spark, "set_undeclared") == sorted(left)
    assert got(spark, "sort_undeclared") == sorted((m, k) for k, (m, _) in enumerate(left, 1))


LOG = "SELECT o_orderkey, l_linenumber * 100000 + l_partkey, l_returnflag = 'R', concat('m', l_partkey % 50), concat('q', l_suppkey % 3) FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def test_all_commits_are_paired(spark):
    want, waiting = [], defaultdict(list)
    for commit, line, removed, mbid, rest in sorted(read(LOG), key=lambda x: x[:2]):
        if removed:
            waiting[commit, rest].append(mbid)
        elif waiting[commit, rest]:
            old = waiting[commit, rest].pop(0)
            if old != mbid:
                want.append((commit, mbid, old))
    assert got(spark, "join_replace_pairing") == sorted(want)
    assert max(want)[0] >= 300


def test_all_dumps_are_folded(spark):
    told, covered = [], 35
    for end, start, name in sorted((k * 10 + 10, k * 10 + c % 17 - 8, str(k)) for k, c in read("SELECT o_orderkey, o_custkey FROM orders")):
        told.append((name, start, end, covered))
        covered = max(covered, end)
    assert len(told) > 400
    assert got(spark, "stream_fold_once") == sorted((n, c, s >= c) for n, s, _, c in told)
    assert got(spark, "stream_late_data") == sorted((n, s, c) for n, s, _, c in told if s < c)
    assert got(spark, "stream_gap_repair") == sorted((n, c, s if s > c else e) for n, s, e, c in told if s > c or (s < c < e))


def test_feeds_have_all_pages(spark):
    parts = read("SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 17 <> 0")
    assert [(r[0], r[2], r[3]) for r in got(spark, "scan_json_cf")] == sorted((k, price, "" if k % 2 else "2024-01-01T00:00:00Z") for k, price in parts)
    released = sorted(r[1] or "" for r in got_rows(spark, "scan_catalogue"))
    assert released == sorted(("1999-01-01", "2001-05-01", "")[k % 3] for k, _ in parts)


def got_rows(spark, name):
    return registry.queries()[name](spark, DATA).collect()


def test_whole_diff_is_reported_and_all_parts_appended(spark):
    desired, actual = set(), set()
    for k, size in read("SELECT p_partkey, p_size FROM part"):
        desired |= {(tier, str(k)) for tier in range(k % 5 + 1)}
        actual.add((size % 5, str(k)))
    groups = defaultdict(list)
    for action, rows in (("add", desired - actual), ("remove", actual - desired)):
        for tier, mbid in rows:
            groups[f"{tier}/{int(mbid) % 997}", action].append(mbid)
    assert got(spark, "report_truncate") == sorted((t, a, len(x), ",".join(sorted(x)) if len(x) <= 4 else "") for (t, a), x in groups.items())
    want = {str(k) for (k,) in read("SELECT CAST(p_partkey AS VARCHAR) FROM part UNION SELECT CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE concat('new ', s_suppkey) END FROM supplier")}
    assert got(spark, "sink_declaration_append") == sorted((s,) for s in want)
