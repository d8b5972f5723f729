"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import ann, decontamination, line_dedup, mixing, ngram_jaccard, pii, sharding, token_counts, toxicity, warc
from cadenza.llm.common import sieve
from cadenza.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, ids=None):
    ids = ids if ids is not None else range(len(texts))
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


def clashing(docs):
    """The same rows with extra columns whose names the operators use themselves."""
    return docs.withColumns({c: F.lit(1) for c in ("words", "spans", "code", "mark", "row", "node", "key", "shard", "sub", "p", "values", "mix_n", "k_text", "pos", "label")})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.integers(0, 400)}" for _ in range(n))


# 1. WARC.


def brute_warc(pages):
    best = {}
    for i, _, html in pages:
        if html is not None and len(html.encode()) >= 1000:
            best[html] = max(i, best.get(html, i))
    out = []
    for i, _, html in pages:
        html = html or ""
        revisit = html in best and i < best[html]
        out.append((i, len(html.encode()), hashlib.sha1(html.encode()).hexdigest(), "revisit" if revisit else "response", best[html] if revisit else None))
    return sorted(out, key=repr)


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "é" * 600), (2, "http://b/", "é" * 600), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "a\r\nb", "x\r\n\r\ny" * 400), (9, "u", "z" * 3_000_000), (8, "u", "é" * 600)]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    folder = f"file://{tmp_path}/bundles"
    records = df.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))
    index = warc.write_bundles(records, folder, frame_bytes=2000, bundle_bytes=4000)
    back = warc.read_bundles(spark, folder)
    got = sorted(((int(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], int(r["refers_to"]) if r["refers_to"] else None) for r in back.collect()), key=repr)
    assert got == brute_warc(pages)
    payloads = {r["id"]: bytes(r["payload"]).decode() for r in back.where("record_type = 'response'").collect()}
    assert payloads["7"] == "x\r\n\r\ny" * 400
    assert payloads["9"] == "z" * 3_000_000
    # Any frame can be read alone, and any standard reader reads the bundle as one stream.
    import zstandard

    for r in index.where("record_id IN ('2', '7')").collect():
        path = f"{tmp_path}/bundles/{r['bundle']}"
        with open(path, "rb") as f:
            f.seek(r["frame_start"])
            frame = zstandard.ZstdDecompressor().decompress(f.read(r["frame_bytes"]))
        assert f"<urn:page:{r['record_id']}>".encode() in frame[r["record_start"] : r["record_start"] + 200]
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(f"{tmp_path}/bundles/{b}", "rb").read()), read_across_frames=True).read() for b in {r["bundle"] for r in index.collect()})
    assert whole.count(b"WARC/1.1\r\n") == len(pages)
    asked = spark.createDataFrame([("7",), ("404",)], "record_id string")
    assert [r["id"] for r in warc.lookup(index, asked, folder).collect()] == ["7"]


def test_bundles_of_lost_attempts_are_not_read(spark, tmp_path):
    """Two attempts of a task saw the rows in another order; one was committed.  A second write shares the folder."""
    import pandas as pd

    folder = f"file://{tmp_path}/bundles"
    texts = {str(i): f"page {i} " * 40 for i in range(199)}
    records = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in texts.items()], "id string, url string, payload string")
    (tmp_path / "bundles").mkdir()
    lost = pd.DataFrame([(i, "u", t, hashlib.sha1(t.encode()).hexdigest(), None) for i, t in reversed(texts.items())], columns=["id", "url", "payload", "digest", "refers_to"])
    assert sum(map(len, warc._writer(folder, "first", 2000, 4000, 3)(iter([lost])))) == 199
    index = warc.write_bundles(records, folder, frame_bytes=2000, bundle_bytes=4000, write_id="first")
    assert Counter(r["id"] for r in warc.read_bundles(spark, folder).collect()) == Counter(texts.keys())
    assert len(list((tmp_path / "bundles").glob("*.warc.zst"))) == index.select("bundle").distinct().count()
    warc.write_bundles(records, folder)
    assert Counter(r["id"] for r in warc.read_bundles(spark, folder).collect()) == Counter([*texts, *texts])


def test_warc_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, url string, payload string")
    warc.write_bundles(empty, f"file://{tmp_path}/none")
    assert warc.read_bundles(spark, f"file://{tmp_path}/none").count() == 0


# 2. Decontamination.

BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return [w.decode() for w in BYTES.findall((text or "").encode().lower())]


def brute_hits(texts, items, window=10):
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            if not v or item_id is None:
                continue
            n = min(window, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(str(item_id))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEM = prose(1, 25)
ITEMS = [(1, ITEM), (12, "Two WORDS"), (3, ""), (4, None), (None, "alpha beta"), (5, "É" + prose(2, 12)), (11, ITEM)]
CONTAMINATED = [ITEM, prose(3, 40), f"{prose(4, 5)} {' '.join(ITEM.split()[3:15])}, {prose(5, 9)}", "two—words TWO, words", None, "", "?!", "é" + prose(2, 12), "É" + prose(2, 12), ("two words " * 6000) + prose(6, 20000), ITEM.upper()]


@pytest.mark.parametrize("bound", [1 << 20, 3000])
def test_decontamination_equals_brute_force(spark, bound):
    docs, bench = clashing(documents(spark, [*CONTAMINATED, *CONTAMINATED[:2]])), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.report(docs, bench, max_broadcast_bytes=bound)
    assert rows(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_hits([*CONTAMINATED, *CONTAMINATED[:2]], ITEMS)


def test_decontamination_removes_documents_or_spans(spark):
    docs, bench = clashing(documents(spark, CONTAMINATED)), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontamination.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    assert kept.columns == docs.columns
    cut = decontamination.decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] == CONTAMINATED[1]
    assert words(texts[2]) == words(f"{prose(4, 5)} {prose(5, 9)}")
    assert words(texts[0]) == []
    assert not decontamination.report(cut, bench).where("contaminated").count()


def test_decontamination_of_empty_tables(spark):
    docs, bench = documents(spark, CONTAMINATED), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(docs, bench).where("contaminated").count() == 0
    assert decontamination.report(docs.limit(0), bench).count() == 0
    assert decontamination.decontaminate(docs, bench).count() == len(CONTAMINATED)


# 3. N-gram Jaccard join.


def grams(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(texts, threshold=0.8):
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(texts)
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and k >= threshold * (len(a) + len(sets[j]) - k):
                n[i] += 1
                n[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, find(i), n[i]) for i in range(len(texts))), key=repr)


def edited(text, at):
    w = text.split()
    for i in at:
        w[i] = f"edit{i}"
    return " ".join(w)


BASE, OTHER, LONG = prose(10, 120), prose(11, 200), prose(12, 20_000)
NEAR = [BASE, BASE.upper(), BASE + "!", edited(BASE, [3]), edited(BASE, [60, 61]), edited(BASE, [2, 118]), edited(BASE, [20, 50, 80, 100, 115]), OTHER, edited(OTHER, [7]), prose(13, 50), LONG, edited(LONG, [50, 900]), None, "", "one two", "One, two!", "three", BASE, BASE, *[edited(BASE, [k]) for k in range(30, 50)]]


@pytest.mark.parametrize(("small", "block"), [(128, 768), (2, 4), (6, 768)])
def test_jaccard_classes_and_links_equal_brute_force(spark, small, block):
    got = ngram_jaccard.classes(clashing(documents(spark, NEAR)), small=small, block=block)
    assert rows(got, "doc_id", "class_id", "n_links") == brute_classes(NEAR)


def test_jaccard_keeps_one_of_each_class(spark):
    docs = clashing(documents(spark, NEAR))
    kept = ngram_jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute_classes(NEAR)})
    twice = ngram_jaccard.deduplicate(docs.unionByName(docs))
    assert sorted(r["doc_id"] for r in twice.collect()) == sorted(r["doc_id"] for r in kept.collect())
    assert ngram_jaccard.classes(docs.limit(0)).count() == 0
    assert ngram_jaccard.classes(documents(spark, ["a b c d e f"] * 3, ids=[None, None, 4])).select("class_id").distinct().collect()[0][0] == 4


def test_banding_reaches_its_recall():
    bands, rows_ = ngram_jaccard.banding(0.8, 0.995, 256)
    assert bands * rows_ <= 256
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.995


@pytest.mark.parametrize("bits", [1 << 16, 1 << 27])
def test_sieve_loses_no_wanted_row_and_drops_most_others(spark, bits):
    df = clashing(spark.range(20_000).selectExpr("id AS doc_id", "xxhash64(id) AS mark").withColumns({"cell": F.lit(1), "bitmap": F.lit(2)}).drop("mark")).withColumn("mark", F.xxhash64("doc_id"))
    wanted = df.where("doc_id % 10 = 0").select("mark")
    passed = sieve(df, wanted, "mark", bits)
    assert passed.columns == df.columns
    ids = {r.doc_id for r in passed.select("doc_id").collect()}
    assert ids >= set(range(0, 20_000, 10)) and len(ids) <= (2_000 + 18_000 * 2_000 / bits * 1.3 + 5)
    assert sieve(df, wanted.limit(0), "mark", bits).isEmpty()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["label"] for r in got.collect()} == {0, 100}


# 4. Token counts.


def test_token_counts_equal_whole_texts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path())
    texts = ["Hello world", None, "", "  two  spaces\n\n<|endoftext|> it's", prose(20, 3000), "a" * 5000, "日本語 " * 500, "x <|endoftext|>y z" * 300, "don't won't 1234 5678" * 99, "é à ßu  x\ty ñ ﬁ 한국 어 a", " lead", "trail ", "a  b"]
    got = token_counts.count_tokens(clashing(documents(spark, [*texts, texts[0]])), batch_bytes=700)
    expected = [(len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for t in [*texts, texts[0]]]
    assert rows(got, "n_bytes", "n_tokens") == sorted(expected, key=repr)
    assert token_counts.count_tokens(documents(spark, texts).limit(0)).count() == 0


def test_sentencepiece_counts(spark):
    from sentencepiece import SentencePieceProcessor

    path = token_counts.tokenizer_path("piece_bpe_32k.model")
    texts = [prose(21, 50), "Été <s> 日本", None]
    got = token_counts.count_tokens(documents(spark, texts), path)
    model = SentencePieceProcessor(model_file=path)
    assert rows(got, "n_tokens") == sorted(((len(model.encode(t or "")),) for t in texts), key=repr)


# 5. Nearest neighbours.


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<float>, label int")


def test_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[500:900] = x[500]  # one very common vector
    df = vectors(spark, x)
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(s == pytest.approx(scores[v], abs=1e-12) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(3000), -scores))[:20].tolist()))
    assert len(got) == 30
    assert hits / (20 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[600])] == list(range(500, 520))


def test_neighbours_leave_out_what_is_no_vector(spark):
    x = [[1, 0], None, [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [1, 1], [2, 0], [1, 2, 3], [1, 0]]
    df = clashing(vectors(spark, x))
    got = ann.nearest(df, df)
    assert rows(got.where("query_id = 0"), "rank", "vec_id", "score") == [(1, 7, 2.0), (2, 6, 1.0), (3, 9, 1.0)]
    assert {r["query_id"] for r in got.collect()} == {0, 6, 7, 9}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# 6. Toxicity.


def toxic_documents(spark, n=600):
    rng = np.random.default_rng(5)
    texts, labels = [], []
    for i in range(n):
        w = [f"{rng.choice(WORDS)}{rng.integers(0, 50)}" for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for k, p in enumerate(rng.choice(40, 4, replace=False)):
                w[p] = ["grumbling", "you idiot", "gruntish", "l0ser!!"][k]
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_ranks_held_out_rows(spark):
    docs, labels = toxic_documents(spark)
    got = toxicity.report(clashing(docs), labels.unionByName(labels.limit(10)))
    both = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in both)
    assert sum(r["predicted"] == r["toxic"] for r in both) / len(both) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in both)
    kept = toxicity.keep(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns
    assert kept.join(labels, "doc_id").where("toxic = 1").count() <= 10
    assert kept.join(labels, "doc_id").where("toxic = 0").count() >= 440


def test_toxicity_without_labels_and_with_odd_texts(spark):
    docs = documents(spark, [None, "", "x" * 200_000, "you idiot"], ids=[1, None, 2, 2])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.report(docs, none)
    assert rows(got, "score", "predicted") == [(0.0, 0)] * 4
    assert toxicity.report(docs.limit(0), none).count() == 0
    assert toxicity.keep(docs, none).count() == 4
    values = toxicity.features(None, {}, {})
    assert len(values) == len(toxicity.FEATURES)
    assert not any(values)


def test_words_are_unmasked():
    assert toxicity.plain("l0s3r!!") == ("loser", True)
    assert toxicity.plain("2024") == ("2024", False)
    assert toxicity.plain("“Hello,”") == ("hello", False)


# 7. Line dedup.


def brute_lines(texts, sources, least):
    sites: dict = {}
    for t, s in zip(texts, sources, strict=True):
        for line in (t or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(s or "")
    out = []
    for t in texts:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if len(sites.get(x.strip(" "), ())) < least]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    texts = [f"All rights reserved.\nown line {i}\n\n  near {i % 2}  \nfew {i // 7}" for i in range(30)] + [None, "", "\n\n", "near 0\nnear 0", "x" * 100_000]
    sources = [f"s{i % 20}" for i in range(len(texts) - 3)] + [None, "s1", "s1"]
    for least in (9, 10, 11):
        got = line_dedup.report(clashing(documents(spark, texts, sources)), least)
        assert rows(got, "n_lines", "n_removed", "kept_sha256") == brute_lines(texts, sources, least)
    docs = clashing(documents(spark, texts, sources))
    removed = line_dedup.remove(docs, 10)
    assert removed.columns == docs.columns
    assert {r["text"] for r in removed.where("doc_id = 1").collect()} == {"own line 1\n\nfew 0"}
    assert line_dedup.report(docs.limit(0), 10).count() == 0


# 8. Sharding.


def test_shards_follow_the_key_and_slots_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SUB_ROWS", 3)
    texts = [None, "", "é", *[prose(i, 5) for i in range(600)]]
    ids = [None, 7, 7, *range(600)]
    got = sharding.report(clashing(documents(spark, texts, ids=ids))).collect()
    by_shard: dict = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len(by_shard) == 24
    assert max(map(len, by_shard.values())) < 60
    moved = sum(r["grown_shard"] == 24 for r in got)
    assert 5 <= moved <= 60
    sizes = Counter((r["size"], r["text_crc32"]) for r in got)
    assert sizes == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert sharding.report(documents(spark, texts).limit(0)).count() == 0


def brute_shard(key, weights):
    import math

    import xxhash

    best = None
    for i, w in enumerate(weights):
        h = xxhash.xxh64(int(key).to_bytes(8, "little", signed=True), seed=42).intdigest()
        h = xxhash.xxh64(i.to_bytes(8, "little"), seed=h).intdigest()
        score = -w / math.log(((h >> 12) + 0.5) / 2.0**52)
        if best is None or score > best[0]:
            best = score, i
    return best[1]


def test_weighted_shards_equal_brute_force(spark):
    weights = (1.0, 2.0, 5.0)
    got = sharding.assign(documents(spark, ["x"] * 300), weights).collect()
    assert [r["shard"] for r in got] == [brute_shard(r["doc_id"], weights) for r in got]
    counts = Counter(r["shard"] for r in got)
    assert counts[0] < counts[1] < counts[2]
    with pytest.raises(ValueError):
        sharding.assign(documents(spark, ["x"]), (1.0, 0.0))


def test_shards_are_written_by_folder(spark, tmp_path):
    docs = clashing(documents(spark, [prose(i, 5) for i in range(50)]))
    sharding.write(docs, f"file://{tmp_path}/out", (1.0, 1.0))
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 50
    assert {p.name for p in (tmp_path / "out").glob("shard_id=*")} == {"shard_id=0", "shard_id=1"}


# 9. PII.


def brute_base(text):
    """The contract's patterns with plain leftmost search."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for order, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            ok = kind == "email"
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            if kind == "card":
                ok = 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


PERSONAL = [
    None, "", "mail a.b@c.example.com, x@y, a@b.c_d@e.f and a@b.c.@d.e", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1, 010.0.0.255, 1.2.3", "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 5",
    "call +1 (459) 555-7415 or +49 30 123456 or +1 2", "é+33 1 23 45 67 89 ñ 4111111111111111@mail.com", "write to jane at mail dot example dot com", "(459) 555-7415", "+" * 50 + "1" * 50_000, "a" * 100_000, "1." * 30_000, "1.2.3.4 " * 3000,
]


def test_base_spans_equal_plain_regular_expressions(spark):
    got = pii.find(clashing(documents(spark, [*PERSONAL, PERSONAL[2]]))).orderBy("doc_id").collect()
    for r, text in zip(got, [*PERSONAL, PERSONAL[2]], strict=True):
        base = brute_base(text)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in pii.KINDS)
    assert pii.find(documents(spark, PERSONAL).limit(0)).count() == 0


def test_base_spans_on_random_texts():
    rng = np.random.default_rng(3)
    alphabet = list("0123456789ab.@-+ ()_%é") + ["1.2.3.", "a@b.c", "+1 2", "4111111111111111"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 30)))
        got = ",".join(f"{k}:{s}:{e}" for k, s, e, c in pii.candidates(text) if c & 1)
        assert got == brute_base(text), text


def test_labelers_are_weighed_and_obfuscated_addresses_added(spark):
    texts = [f"contact: user{i}@mail{i}.example.com or phone +1 459 555 {1000 + i}" for i in range(60)]
    texts += [f"e-mail: name{i} (at) mail (dot) example (dot) com" for i in range(20)] + [f"order 1234 5678 9012 345{i % 10}" for i in range(20)] + ["nothing at all here"] * 20
    got = pii.find(documents(spark, texts)).orderBy("doc_id").collect()
    assert sum("email" in r["spans"] for r in got[60:80]) >= 18
    assert not any("card" in r["spans"] for r in got[80:100] if not r["n_card"])
    assert not any(r["spans"] for r in got[100:])
    kind, votes = np.zeros(2, int), np.array([[1, 1, 1, 1, 1, 1], [0, 2, 2, 2, 2, 2]])
    p, reliability = pii.estimate(kind, votes, np.array([50, 50]))
    assert p[0] > 0.95
    assert p[1] < 0.05
    assert np.allclose(reliability.sum(axis=2), 1)


# 10. Mixing.


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("fan_in", [4, 128])
def test_mix_comes_near_its_targets(spark, fan_in):
    texts, sources = [], []
    for s, n in (("b", 500), ("a", 3), (None, 40), ("é", 60), ("z", 1), ("c", 1)):
        for i in range(n):
            texts.append(prose(i, 3 + i % 37))
            sources.append(s)
    texts += [None, "", "same text", "same text"]
    sources += ["a", "c", "b", "b"]
    docs = clashing(documents(spark, texts, sources, ids=[*range(len(texts) - 1), len(texts) - 2]))
    got = mixing.copies(docs, fan_in=fan_in).collect()
    sizes: dict = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, taken, largest = brute_targets(sizes), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(texts)
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in target)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.copies(docs.repartition(7), fan_in=fan_in)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    whole = Counter()
    for r in mixing.copies(docs).collect():
        whole[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +whole


def test_rounding_keeps_expected_copies(spark):
    docs = documents(spark, ["w " * (1 + i % 5) for i in range(40)], ["a"] * 20 + ["b"] * 20)
    total = Counter()
    for seed in range(12):
        for r in mixing.copies(docs, weights=(3.0, 1.0), seed=seed).collect():
            total[r["source"]] += r["copies"]
    assert total["a"] / 240 == pytest.approx(1.5, abs=0.15)
    assert total["b"] / 240 == pytest.approx(0.5, abs=0.15)


def test_mix_of_nothing(spark):
    docs = documents(spark, [None, "", " \n"])
    assert rows(mixing.report(docs), "taken") == [(0,)] * 3
    assert mixing.report(docs.limit(0)).count() == 0
    assert mixing.mix(docs).count() == 0
