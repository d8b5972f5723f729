"""The whole recommendation and its communities against plain Python on the driver's smallest tables."""

from __future__ import annotations

import hashlib
import os
from collections import Counter, defaultdict
from math import log, sqrt
from statistics import median

import duckdb
import pytest

from cadenza import registry
from cadenza import schema as S

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def uid(key):
    h = hashlib.md5(str(key).encode()).hexdigest()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def attraction(plays, center, low, high):
    room = min(log(2), (high - low) / 3)
    turn = min(max(min(max(center, log(4)), log(12)), room), high - room)
    x = log(max(plays, 1))
    side = 50 * min((x - turn) / max(high - turn, 1e-6), 1) if x >= turn else 25 * max((x - turn) / max(turn, 1e-6), -1)
    return side * (high - low) / (high - low + log(3)) / 50


class World:
    """Everything up to who hears what, from raw tables."""

    def __init__(self):
        c = duckdb.connect()
        rows = c.sql(f"SELECT o_custkey, l_partkey, CAST(l_quantity AS BIGINT), p_brand, p_type FROM '{DATA}/lineitem.parquet' JOIN '{DATA}/orders.parquet' ON l_orderkey = o_orderkey JOIN '{DATA}/part.parquet' ON l_partkey = p_partkey").fetchall()
        self.types = [t for (t,) in c.sql(f"SELECT DISTINCT p_type FROM '{DATA}/part.parquet' WHERE p_type LIKE 'E%'").fetchall()]
        library, self.artists = Counter(), {}
        for user, part, n, brand, kind in rows:
            library[user, uid(part)] += n
            if part % 11:
                self.artists[uid(part)] = {f"{brand}/{kind}", f"feat/{brand}"} if part % 7 == 0 else {f"{brand}/{kind}"}
        self.declared = {uid(part): part % 5 for user, part, *_ in rows if user == 1}
        held = Counter(user for user, song in library if song in self.declared)
        own = min(held, key=lambda u: (-held[u], u))
        often = Counter(user for (user, _), n in library.items() if n >= 3)
        self.plays = defaultdict(dict)
        for (user, song), n in library.items():
            if user != own and often[user] >= 20:
                self.plays[user][song] = min(n, 65535)
        self.stat = {}
        for user, songs in self.plays.items():
            total, told, reached = sum(songs.values()), [], 0
            for n in sorted(songs.values()):
                reached += n
                told.append((reached, log(max(n, 1))))
            # Equal numbers of plays count together.
            reach = {x: r for r, x in told}
            at = lambda p, reach=reach, total=total: min(x for x, r in reach.items() if r >= p * total)
            self.stat[user] = (at(0.5), at(0.05), at(0.99))
        self.heard = defaultdict(dict)
        for user, songs in self.plays.items():
            for song in songs.keys() & self.declared.keys():
                self.heard[song][user] = attraction(songs[song], *self.stat[user])

    def cosine(self):
        out, names = {}, sorted(self.heard)
        for k, a in enumerate(names):
            for b in names[k + 1 :]:
                if shared := len(self.heard[a].keys() & self.heard[b].keys()):
                    out[a, b] = shared / sqrt(len(self.heard[a]) * len(self.heard[b]))
        return out


def quality(label, weights, resolution):
    """Modularity, from its definition."""
    total = sum(weights.values()) * 2
    inside, degree = defaultdict(float), defaultdict(float)
    for (a, b), w in weights.items():
        degree[label[a]] += w
        degree[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += 2 * w
    return sum(inside[c] / total - resolution * (degree[c] / total) ** 2 for c in degree) if total else 0.0


def communities(names, cosine, threshold, resolution, least):
    """Nodes in order move to the community with the best modularity; then communities are the nodes."""
    groups = [[n] for n in sorted(names)]
    while True:
        member = {n: i for i, g in enumerate(groups) for n in g}
        weights = defaultdict(float)
        for (a, b), w in cosine.items():
            if w >= threshold:
                weights[tuple(sorted((member[a], member[b])))] += w
        label, moving = list(range(len(groups))), bool(weights)
        # A pair inside one node counts in full at every place the node may move to.
        while moving:
            moving = False
            for i in range(len(groups)):
                near = {label[j] for a, b in weights for j in (a, b) if i in (a, b) and a != b and j != i} | {label[i]}
                scored = {}
                for c in near:
                    scored[c] = quality({**dict(enumerate(label)), i: c}, weights, resolution)
                best = min(near, key=lambda c: (-round(scored[c], 12), c))
                if scored[best] > scored[label[i]] + 1e-12:
                    label[i], moving = best, True
        merged = defaultdict(list)
        for i, g in enumerate(groups):
            merged[label[i]] += g
        if len(merged) == len(groups):
            break
        order = list(dict.fromkeys(label))
        groups = [merged[c] for c in order]
    where = {n: i for i, g in enumerate(groups) for n in g}
    while least > 1:
        sizes = Counter(where.values())
        small = [c for c in sizes if sizes[c] < least]
        if len(sizes) < 2 or not small:
            break
        gone = min(small, key=lambda c: (sizes[c], c))
        biggest = min((c for c in sizes if c != gone), key=lambda c: (-sizes[c], c))
        for n in sorted(n for n in where if where[n] == gone):
            peers = [(-w, b if a == n else a) for (a, b), w in cosine.items() if n in (a, b) and where[b if a == n else a] != gone]
            where[n] = where[min(peers)[1]] if peers else biggest
    order = {c: i for i, c in enumerate(dict.fromkeys(where[n] for n in sorted(where)))}
    return {n: order[c] for n, c in where.items()}


def recommended(world, where, least_backers=5):
    users = {u for of in world.heard.values() for u in of}
    pull = defaultdict(float)
    for song, of in world.heard.items():
        seed = (S.Q_VALUES[world.declared[song]] - 50) / 50 * log(len(users) / len(of))
        if seed:
            for user, w in of.items():
                pull[where[song], user] += 0 if seed < 0 and w < 0 else seed * w
    cohort = defaultdict(list)
    for (island, user), w in sorted(pull.items(), key=lambda x: (-round(x[1], 9), x[0][1])):
        if w > 0 and len(cohort[island]) < 500:
            cohort[island].append((user, w))
    usual = median(len(songs) for songs in world.plays.values())
    weight, backers = defaultdict(float), Counter()
    for island, members in cohort.items():
        for user, w in members:
            for song, n in world.plays[user].items():
                drawn = attraction(n, *world.stat[user])
                weight[island, song] += w * drawn / sqrt(max(len(world.plays[user]), 1) / usual)
                backers[island, song] += drawn > 0
    known = {a for song in world.declared for a in world.artists.get(song, ())}
    for kind in world.types:
        pair = {f"Brand#1/{kind}", f"Brand#2/{kind}"}
        if pair & {a for song in world.declared for a in world.artists.get(song, ())}:
            known |= pair
    listeners = Counter(song for songs in world.plays.values() for song in songs)
    scores = {(i, s): w / max(listeners[s], 1) ** (1 / 3) for (i, s), w in weight.items() if w > 0 and backers[i, s] >= least_backers and s not in world.declared and not world.artists.get(s, set()) & known}
    best = {}
    for (island, song), score in scores.items():
        for artist in world.artists.get(song, ()):
            best[artist] = min(best.get(artist, (0, "", 0)), (-score, song, island))
    kept = [(island, song, score) for (island, song), score in scores.items() if world.artists.get(song) and all(best[a] == (-score, song, island) for a in world.artists[song])]
    out = []
    for island in {i for i, *_ in kept}:
        mine = sorted((-score, song) for i, song, score in kept if i == island)[:200]
        out += [(island, k, song, round(-s, 6), backers[island, song], listeners[song]) for k, (s, song) in enumerate(mine, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def world():
    return World()


@pytest.mark.parametrize(("name", "least"), [("graph_louvain", 1), ("graph_absorb_small", 4)])
def test_communities_equal_brute_force(spark, world, name, least):
    got = {r["mbid"]: r["island"] for r in registry.queries()[name](spark, DATA).collect()}
    assert got == communities(world.heard, world.cosine(), 0.05, S.GRANULARITY, least)


@pytest.mark.parametrize(("name", "threshold", "least"), [("recommend_all", 0.05, 4), ("recommend_defaults", S.SIMILARITY, S.MIN_COMMUNITY)])
def test_recommendation_equals_brute_force(spark, world, name, threshold, least):
    want = recommended(world, communities(world.heard, world.cosine(), threshold, S.GRANULARITY, least))
    rows = registry.queries()[name](spark, DATA).select("island", "position", "mbid", "score", "backer", "listener").collect()
    got = sorted((r["island"], r["position"], r["mbid"], r["score"], r["backer"], r["listener"]) for r in rows)
    assert [(*g[:3], *g[4:]) for g in got] == [(*w[:3], *w[4:]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
    assert got
