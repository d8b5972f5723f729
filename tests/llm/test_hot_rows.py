"""Hot groups, repeated rows and planted spans: what one key or one group must not break."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import ann, decontamination, mixing, pii, sharding, token_counts
from cadenza.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Mixing and sharding.


def test_rows_that_differ_in_another_column_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, "a b c", "fr", "s", 5)], DOCS)
    mixed = Counter(r["lang"] for r in mixing.mix(docs).collect())
    assert mixed == {"en": 1, "fr": 1}  # one source: its target is its size


def test_many_equal_rows_share_their_copies(spark):
    hot = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x y").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    rest = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("b").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    docs = hot.unionByName(rest)
    got = mixing.report(docs).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": 20_000, "b": 3_000}
    assert all(abs(r["taken"] - r["target"]) <= 2 and r["most"] <= 3 for r in got)
    taken = Counter({r["source"]: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()})
    assert taken == {r["source"]: r["taken"] // 2 for r in got}
    placed = sharding.report(docs)
    slots = placed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    assert sum(r["n"] for r in slots) == 23_000
    assert all(r["n"] == r["slots"] == r["high"] + 1 and r["low"] == 0 for r in slots)


def settle(members, last):
    """One group, largest first, as the docstring tells it: [size, p, u] of each member, p changed in place."""

    def near(p):
        return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p

    for i, (size, p, u) in enumerate(members):
        if not 0 < p < 1:
            continue
        others = [x for x in members[i + 1 :] if 0 < x[1] < 1]
        fair = [min(x[1], (1 - x[1]) * (1 - p) / p) for x in others]
        cap, low, room = sum(x[0] * f for x, f in zip(others, fair, strict=True)), sum(x[0] * x[1] for x in others), sum(x[0] * (1 - x[1]) for x in others)
        up, down = size * (1 - p), size * p
        if cap >= up:
            rises = u < p
            for x, f in zip(others, fair, strict=True):
                x[1] = near(x[1] + f * (-up / cap if rises else p / (1 - p) * up / cap))
            members[i][1] = 1.0 if rises else 0.0
            continue
        able = low >= up and room >= down
        rises = u < p if able else up - low <= down - room if last else u < room / max(low + room, 1e-9)
        moved = min(up, low) if rises else min(down, room)
        for x in others:
            x[1] = near(x[1] - x[1] * moved / low if rises else x[1] + (1 - x[1]) * moved / room)
        members[i][1] = float(rises) if last else near(p + moved / size * (1 if rises else -1))


@pytest.mark.parametrize("last", [False, True])
def test_a_group_is_settled_as_a_plain_loop_does(spark, last):
    rng = np.random.default_rng(4 + last)
    kind = "g int, size bigint, p double, u double, id int"
    groups = {g: sorted([[int(rng.integers(1, 400) ** 2 // 900 + 1), float(rng.uniform(0.05, 0.95)), float(rng.uniform()), i] for i in range(1 + g)], reverse=True) for g in range(25)}
    items = spark.createDataFrame([(g, *m) for g, members in groups.items() for m in members], kind).select("g", F.struct("size", "p", "u", "id").alias("item"))
    settled = items.groupBy("g").agg(mixing.settled_group(F.sort_array(F.collect_list("item"), asc=False), F.lit(last)).alias("all")).collect()
    for r in settled:
        members = [m[:3] for m in groups[r["g"]]]
        mass = sum(m[0] * m[1] for m in members)
        settle(members, last)
        assert [x["p"] for x in r["all"]] == pytest.approx([m[1] for m in members])
        assert sum(0 < m[1] < 1 for m in members) <= (0 if last else 1)
        assert last or sum(m[0] * m[1] for m in members) == pytest.approx(mass)


def test_settling_keeps_expectations(spark):
    """A group whose small members can make up for its large one: each is taken as often as its p says."""
    sizes = [300, *[10 + i for i in range(40)]]
    items = spark.range(3000).select(F.col("id").alias("g"), F.posexplode(F.array(*map(F.lit, sizes))).alias("k", "size"))
    item = F.struct(F.col("size").cast("long").alias("size"), F.lit(0.3).alias("p"), F.rand(5).alias("u"), F.col("k").alias("id"))
    drawn = items.select("g", item.alias("item")).groupBy("g").agg(mixing.settled_group(F.sort_array(F.collect_list("item"), asc=False), F.lit(True)).alias("all"))
    got = {r["k"]: r["mean"] for r in drawn.select(F.explode("all").alias("x")).groupBy(F.col("x.id").alias("k")).agg(F.avg("x.p").alias("mean")).collect()}
    assert got[0] == pytest.approx(0.3, abs=0.03) and all(got[k] == pytest.approx(0.3, abs=0.05) for k in range(12, 41))
    # The few smallest settle what is left, so theirs may be off; what all take together is not.
    assert sum(size * got[k] for k, size in enumerate(sizes)) == pytest.approx(0.3 * sum(sizes), rel=0.01)


@pytest.mark.parametrize(("folder", "most"), [("sf0.01", 0.02), ("sf0.1", 0.01)])
def test_every_source_is_near_its_target(spark, folder, most):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    got = mixing.report(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) > 10 and all(abs(r["taken"] - r["target"]) <= most * r["target"] for r in got)


def test_one_component_of_many_nodes(spark):
    star = spark.range(1, 60_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(60_000, 100_000).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components(star.unionByName(chain))
    assert got.count() == 100_000
    assert got.where("label <> 0").isEmpty()


# Nearest neighbours.


def brute_nearest(x, ids, k):
    """By sums in the order of the components, without the query's own row, ties to the smaller id."""
    out = {}
    for q in range(len(x)):
        scores = []
        for v in range(len(x)):
            if v != q:
                total = 0.0
                for a, b in zip(x[v], x[q], strict=True):
                    total += a * b
                scores.append((-total, ids[v]))
        out[q] = sorted(scores)[:k]
    return out


def test_ties_go_to_the_smaller_id():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(25, 90))
        x = np.repeat(rng.standard_normal((1, 64)).astype(np.float32), n, axis=0).astype(float)
        ids = rng.permutation(n).astype(np.int64)
        found, scores = ann.best_of(ids, x, np.linalg.norm(x, axis=1), x[0], 20)
        assert ids[found].tolist() == list(range(20))
        assert len(set(scores.tolist())) == 1


def test_products_that_overflow_lose_no_neighbour(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 8))
    x[:30] *= 1e160  # products beyond the largest number, of either sign
    x[30:60] *= 1e-160
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(vectors, vectors.where("vec_id % 3 = 0"), shard_rows=30, recall=1.0).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 90, 3):
        assert len(found[q]) == 20 and all(not np.isnan(s) for _, s in found[q])
        scores = [s for _, s in found[q]]
        assert scores == sorted(scores, reverse=True)
        if q < 30:  # the infinite ones come first, ties to the smaller id
            far = [v for v in range(30) if v != q and float(np.dot(x[q] * 2.0**-600, x[v] * 2.0**-500)) > 0]
            assert [v for v, s in found[q] if np.isinf(s)] == far[:20]


def test_a_shard_of_which_no_share_suffices_is_searched_whole():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 48))
    forest = ann.Forest.of(np.arange(400), x, 1, 0)
    assert ann.share_needed(forest, 20, 1.0, (0.05, 0.1), 16) == 1.0


def test_repeated_ids_leave_out_their_own_row_only(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[11] = x[10]
    x[21] = x[20]
    ids = [*range(60)]
    ids[11] = 10  # equal id and vector
    ids[31] = 30  # equal id, another vector
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    want = brute_nearest(x.astype(float), ids, 20)
    for shard_rows in (16, 1000):
        got: dict = {}
        for r in ann.nearest(df, df, recall=2.0, shard_rows=shard_rows).collect():
            got.setdefault(r["query_id"], Counter())[r["vec_id"]] += 1
        # Two queries of one id report both.
        for q in (10, 20, 21, 30, 40):
            rows = [i for i in range(60) if ids[i] == q]
            exact = Counter(v for i in rows for _, v in want[i])
            assert sum(got[q].values()) == 20 * len(rows)
            assert sum((got[q] & exact).values()) >= 0.9 * 20 * len(rows)
        assert got[10][10] == 2  # each of the two equal rows finds the other
        assert got[30][30] <= 2


def test_small_shards_are_not_searched_whole():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 32))
    x = np.concatenate([c + 0.1 * rng.standard_normal((50, 32)) for c in centres])
    forest = ann.Forest.of(np.arange(1000), x, ann.TREES, ann.SEED)
    share = ann.share_needed(forest, 20, 0.95, ann.SHARES, 64)
    assert share <= 0.2
    met = [len(m) for m in forest.candidates(x[:100], ann._wanted(share, 1000, 20))]
    assert np.mean(met) <= 500


# Personal data.


def planted(n):
    rng = np.random.default_rng(9)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    say = lambda k: " ".join(rng.choice(words, k))
    texts, true = [], []
    for i in range(n):
        phone, ip = f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}", ".".join(str(rng.integers(1, 255)) for _ in range(4))
        stem = f"4{rng.integers(10**13, 10**14 - 1)}0"
        card = next(c for c in (f"{stem}{d}" for d in range(10)) if pii.luhn(c))
        mail = f"{rng.choice(words)}{i}@mail{i % 7}.example.com"
        kind = i % 10
        text = [f"{say(5)} {phone} {say(4)}", f"{say(5)} {mail} {say(4)}", f"{say(3)} {card} {say(5)}", f"{say(3)} {ip} {say(5)}", f"{say(4)} {phone} {ip} {say(3)}", f"{say(4)} {card} {card} {say(3)}", f"{say(4)} write to {rng.choice(words)}{i} (at) mail{i % 7} (dot) example (dot) com {say(3)}", f"{say(4)} invoice 1234 5678 9012 {1000 + i} {say(2)}", f"{say(3)} looked at {say(2)} . {say(3)}", f"{say(4)} order no 00{rng.integers(10**12, 10**13)} {say(3)}"][kind]
        want = [phone] if kind == 4 else [card, card] if kind == 5 else [f"{text.split('write to ')[1].split(' com ')[0]} com"] if kind == 6 else []
        texts.append(text)
        true.append(want)
    return texts, true


def test_added_spans_are_those_that_were_planted(spark):
    texts, true = planted(600)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    right = added = wanted = 0
    for r in pii.find(docs).collect():
        text = texts[r["doc_id"]]
        base = {(k, s, e) for k in pii.KINDS for s, e in pii.base_runs(k, text)[0]}
        spans = {(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)}
        assert base <= spans
        more = Counter(text[s:e] for _, s, e in spans - base)
        right += sum((more & Counter(true[r["doc_id"]])).values())
        added += sum(more.values())
        wanted += len(true[r["doc_id"]])
    assert right / wanted >= 0.9
    assert right / added >= 0.95


def test_expectation_maximisation_equals_a_loop_over_spans():
    rng = np.random.default_rng(2)
    kind, votes, n = rng.integers(0, 4, 12), rng.integers(0, 3, (12, 6)), rng.integers(1, 9, 12)
    spans = [(int(k), v.tolist()) for k, v, m in zip(kind, votes, n, strict=True) for _ in range(m)]
    p = [1 / (1 + math.exp(-(1.5 * (v.count(1) - v.count(2)) - 0.5))) for _, v in spans]
    for _ in range(5):
        odds = [math.log(((sum(q for q, (k2, _) in zip(p, spans) if k2 == k) + 1) / (sum(k2 == k for k2, _ in spans) + 2)) / (1 - (sum(q for q, (k2, _) in zip(p, spans) if k2 == k) + 1) / (sum(k2 == k for k2, _ in spans) + 2))) for k, _ in spans]
        for i in range(6):
            told = {}
            for y in (0, 1):
                mass = [q if y else 1 - q for q in p]
                prior = [[1, 1, 11], [1, 11, 1]][y]
                for v in range(3):
                    told[y, v] = (sum(m for m, (_, w) in zip(mass, spans) if w[i] == v) + prior[v]) / (sum(mass) + sum(prior))
            odds = [o + math.log(told[1, w[i]] / told[0, w[i]]) for o, (_, w) in zip(odds, spans)]
        p = [1 / (1 + math.exp(-max(-30, min(30, o)))) for o in odds]
    got, _ = pii.estimate(kind, votes, n, rounds=5)
    assert np.allclose(np.repeat(got, n), p)


# Tokens and decontamination.


def test_safe_boundaries_in_any_script():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path())
    texts = ["привет мир " * 50, "日本語の文章です。次の文、そして終わり！" * 40, "١٢٣ ٤٥٦\nabc\nd\n\ne \n f", "a b 　c d e", "x<|endoftext|> y <|endoftext|>", "1 2 3 '4 's 'll don't ' s" * 20, "é ́x y" * 30]
    for text in texts:
        cut = token_counts.pieces(text)
        assert "".join(cut) == text
        assert sum(len(tokenizer.encode(c, add_special_tokens=False)) for c in cut) == len(tokenizer.encode(text, add_special_tokens=False)), text
    assert len(token_counts.pieces(texts[0])) > 90
    assert len(token_counts.pieces(texts[1])) > 70
    rng = np.random.default_rng(8)
    alphabet = list("ab1 '\n\t.é日。　") + ["  ", "<|endoftext|>", "́"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet, rng.integers(1, 150)))
        assert sum(len(tokenizer.encode(c, add_special_tokens=False)) for c in token_counts.pieces(text)) == len(tokenizer.encode(text, add_special_tokens=False)), repr(text)


def test_a_window_of_very_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_A_ROW", 3)
    bench = spark.createDataFrame([(i, "one two three") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four")], "doc_id long, text string")
    assert decontamination.benchmark_windows(bench).agg(F.max(F.size("items"))).first()[0] < 20
    for bound in (1 << 20, 200):
        row = decontamination.report(docs, bench, max_broadcast_bytes=bound).first()
        assert (row["n_hit"], row["n_items"]) == (3, 20)
