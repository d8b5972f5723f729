"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, and verified pairs.

A document's n-grams are its distinct runs of ``n`` words (fewer words, but not none: one n-gram of all);
two documents are linked if the Jaccard similarity of these sets is at least ``threshold``.

1.  Documents with one and the same set form a class at once; only one representative goes on, weighted
    by its copies, so a text repeated a million times costs one row.
2.  Band and row counts are the most selective ones (most rows per band) that find a pair at the
    threshold with probability ``recall`` within ``MAX_HASHES`` hash functions.  Representatives are
    shuffled on band hashes.
3.  In buckets of at most ``SMALL`` members, pairs are listed; each distinct pair is verified once, in the
    smallest bucket that it shares, to which each text's n-grams are sent once.
4.  Larger buckets are cut into blocks of ``BLOCK`` members.  A task holds two blocks, compares all their
    pairs by matrix products, and returns counts of links and a spanning forest instead of the pairs, so
    no task and no output grows with the square of a bucket.  A pair counts in its smallest large bucket
    unless a small one has listed it.
5.  Classes are the connected components of the links.

``n_links`` is the number of other documents at similarity ``threshold`` or more.  Class ids are the
smallest doc_id of a class.

Edge cases: texts without words (null, empty) link to nothing and are classes of their own; repeated rows
are copies of each other; rows with null doc_id take part, and a class of only such rows has a null id;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import WORD_BYTES, columns, free_name, marks, materialize, sieve, split, table
from cadenza.llm.components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.995
MAX_HASHES = 256
SMALL = 128
BLOCK = 768
SEED = 11
_WORDS = re.compile(WORD_BYTES)
#: Words of one batch of texts whose n-grams are hashed together.
_BATCH_WORDS = 50_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band that reach the recall at the threshold within max_hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = max(1, -int(-log(1 - recall) // log(1 - threshold**rows)) + 1) if threshold < 1 else 1
        while bands > 1 and 1 - (1 - threshold**rows) ** (bands - 1) >= recall:
            bands -= 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def text_grams(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct n-gram hashes, one after the other, and how many each has."""
    ids: dict[bytes, int] = {}
    get, hashed = ids.get, xxhash.xxh64_intdigest
    words, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = _WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else ()
        lengths[i] = len(found)
        for w in found:
            h = get(w)
            if h is None:
                h = ids[w] = hashed(w)
            words.append(h)
    words = np.array(words, np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # Polynomials over the n words; those that would cross into the next text are left out.
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(n):
            grams = (grams ^ (grams >> np.uint64(29))) * factor + words[k : k + len(grams)]
    sets, counts = [], np.zeros(len(texts), np.int64)
    for i, length in enumerate(lengths):
        if length >= n:
            own = np.unique(grams[starts[i] : starts[i] + length - n + 1])
        elif length:
            own = np.array([hashed(words[starts[i] : starts[i] + length].tobytes())], np.uint64)
        else:
            continue
        counts[i] = len(own)
        sets.append(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def band_hashes(grams: np.ndarray, counts: np.ndarray, bands: int, rows: int, seed: int = SEED) -> np.ndarray:
    """One row of band hashes for each text that has n-grams."""
    own = counts[counts > 0]
    if not len(own):
        return np.zeros((0, bands), np.int64)
    rng = np.random.default_rng(seed)
    factors, shifts = rng.integers(1, 1 << 32, bands * rows, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, bands * rows, np.uint32)
    starts = np.concatenate([[0], np.cumsum(own)[:-1]])
    mixed = ((grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(own), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(own), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            least = np.minimum.reduceat(mixed * factors[r] + shifts[r], starts)
            h = (h ^ least) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out[:, b] = h
    return out.view(np.int64)


def _signer(n: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False) // 6 + 1)
            cuts = [0, *(np.flatnonzero(np.diff(sizes // _BATCH_WORDS)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                batch = whole.slice(lo, hi - lo)
                grams, counts = text_grams(batch.column("text").to_pylist(), n)
                signed = iter(band_hashes(grams, counts, bands, rows))
                ends = np.cumsum(counts)
                keys = [xxhash.xxh3_128_digest(grams[e - c : e].tobytes()) if c else None for e, c in zip(ends, counts, strict=True)]
                lists = [next(signed) if c else None for c in counts]
                own = [batch.column(c) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "set_key", "bands"])

    return sign


def _grammer(n: int):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found, _ = text_grams([batch.column("text")[i].as_py()], n)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, 1), pa.array([found.tobytes()], pa.binary())], ["node", "grams"])

    return grams


def _shared(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """Sizes of all pairwise intersections (between the first ``split`` sets and the rest, or among all)."""
    left, right = (sets, sets) if split is None else (sets[:split], sets[split:])
    out = np.zeros((len(left), len(right)), np.float32)
    values, ids, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = seen[ids] > 1
    ids, owner = ids[kept], owner[kept]
    if not len(ids):
        return out
    columns = np.unique(ids, return_inverse=True)[1]
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    step = max(256, 4_000_000 // len(sets))
    for lo in range(0, int(columns[-1]) + 1, step):
        a, b = np.searchsorted(columns, [lo, lo + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:b], columns[a:b] - lo] = 1
        out += part @ part.T if split is None else part[:split] @ part[split:].T
    return out


def _linked(sets: list[np.ndarray], threshold: float, split: int | None = None) -> np.ndarray:
    sizes = np.array([len(s) for s in sets], np.float64)
    both = _shared(sets, split).astype(np.float64)
    rows, columns = (sizes, sizes) if split is None else (sizes[:split], sizes[split:])
    return both >= threshold * (rows[:, None] + columns[None, :] - both) - 1e-9


def _pair_verifier(threshold: float):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        pairs, sets = rows[rows["is_pair"]], rows[~rows["is_pair"]]
        place = {node: i for i, node in enumerate(sets["node"])}
        arrays = [np.frombuffer(g, np.uint64) for g in sets["grams"]]
        a, b = pairs["node"].map(place).to_numpy(int), pairs["b"].map(place).to_numpy(int)
        if len(arrays) > 4:
            ok = _linked(arrays, threshold)[a, b]
        else:
            ok = np.array([(k := len(np.intersect1d(arrays[i], arrays[j], assume_unique=True))) >= threshold * (len(arrays[i]) + len(arrays[j]) - k) - 1e-9 for i, j in zip(a, b, strict=True)], bool)
        return pd.DataFrame({"a": pairs["node"].to_numpy(), "b": pairs["b"].to_numpy()})[ok]

    return verify


def _block_verifier(threshold: float):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks of a large bucket (or within one): counts and a spanning forest."""
        this, first, second = rows["key"].iloc[0], rows["first"].iloc[0], rows["second"].iloc[0]
        rows = rows.sort_values(["block", "node"])
        split = None if first == second else int((rows["block"] == first).sum())
        nodes, weights = rows["node"].to_numpy(), rows["copies"].to_numpy()
        if split == 0 or split == len(rows):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        linked = _linked([np.frombuffer(g, np.uint64) for g in rows["grams"]], threshold, split)
        # Which pairs belong to this bucket: no smaller large bucket and no small bucket holds both.
        bands, small = np.stack(rows["bands"].to_numpy()), np.stack(rows["small"].to_numpy()).astype(bool)
        left, right = (slice(None), slice(None)) if split is None else (slice(0, split), slice(split, None))
        for band in range(bands.shape[1]):
            same = bands[left, band][:, None] == bands[right, band][None, :]
            linked &= ~(same & (small[left, band][:, None] | (bands[left, band][:, None] < this)))
        if split is None:
            np.fill_diagonal(linked, False)
            counts = linked @ weights
            full = linked
        else:
            counts = np.concatenate([linked @ weights[split:], linked.T @ weights[:split]])
            full = np.zeros((len(rows), len(rows)), bool)
            full[:split, split:] = linked
            full[split:, :split] = linked.T
        label = np.arange(len(rows))
        while True:
            lower = np.minimum(label, np.where(full, label[None, :], len(rows)).min(axis=1))
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        got = counts > 0
        return pd.DataFrame({"a": nodes[got], "b": nodes[label[got]], "n": counts[got]})

    return verify


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, edges, counts): members (doc_id, k1, k2, node) of all documents with n-grams or without (null
    node); edges (a, b) that span the links between nodes; counts (node, n_links, least) with each node's linked
    documents and smallest doc_id."""
    bands, rows = banding(threshold, recall)
    # k1 and k2 name a row's id and text: they lead back to the text without shuffling every text.
    marked = docs.select("doc_id", *[c.alias(k) for k, c in zip(("k1", "k2"), marks("doc_id", "text"), strict=True)], "text")
    signed = materialize(marked.mapInArrow(_signer(n, bands, rows), marked.drop("text").schema.add("set_key", "binary").add("bands", T.ArrayType(T.LongType()))), "signed")
    # A node is a distinct set, by 128 bits of its hash; it gets a number, which later joins carry.
    sets = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.count("*").alias("copies"), F.first("bands").alias("bands"), F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("best"))
    nodes = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = materialize(signed.drop("bands").join(nodes.select("set_key", "node"), "set_key", "left").select("doc_id", "k1", "k2", "node"), "members")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    held = materialize(sieve(keyed, buckets, "key").join(buckets.hint("shuffle_hash"), "key"), "held")

    # Small buckets: distinct pairs, each at home in the smallest bucket that lists it.
    few = held.where(F.col("size") <= small).select("key", "node")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))).select("x.key", F.col("x.node").alias("node"), F.col("y.node").alias("b"))
    pairs = materialize(pairs.groupBy("node", "b").agg(F.min("key").alias("home")), "pairs")
    visits = pairs.select("home", "node").unionByName(pairs.select("home", F.col("b").alias("node"))).distinct()
    large = held.where(F.col("size") > small)
    wanted = visits.select("node").unionByName(large.select("node")).distinct()
    # The n-grams of the nodes that have company; one text stands for each node.
    best = materialize(nodes.join(wanted, "node", "left_semi").select("node", "best.k1", "best.k2"), "marks")
    # Rows that repeat id and text become one before the shuffle, which the join then shares.
    texts = sieve(marked.select("k1", "k2", "text"), best, "k1").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    texts = texts.join(best.hint("shuffle_hash"), ["k1", "k2"]).select("node", "text")
    grams = materialize(texts.mapInArrow(_grammer(n), "node long, grams binary"), "grams")

    sent = visits.join(grams, "node").select("home", "node", "grams", F.lit(0).cast("long").alias("b"), F.lit(False).alias("is_pair"))
    sent = sent.unionByName(pairs.select("home", "node", F.lit(None).cast("binary").alias("grams"), "b", F.lit(True).alias("is_pair")))
    verified = materialize(sent.groupBy("home").applyInPandas(_pair_verifier(threshold), "a long, b long"), "verified")

    # Large buckets: every two blocks of a bucket meet in one task.
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "node", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    is_small = F.transform("bands", lambda k: F.array_contains(F.col("small_keys"), k))
    small_keys = few.join(large.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_list("key").alias("small_keys"))
    facts = nodes.join(large.select("node").distinct(), "node", "left_semi").join(small_keys, "node", "left").withColumn("small_keys", F.coalesce("small_keys", F.array().cast("array<bigint>")))
    facts = facts.select("node", "copies", "bands", is_small.alias("small")).join(grams, "node")
    forest = materialize(dealt.join(facts, "node").groupBy("key", "first", "second").applyInPandas(_block_verifier(threshold), "a long, b long, n long"), "forest")

    weight = nodes.select(F.col("node").alias("w_node"), "copies")
    listed = verified.select("a", "b").unionByName(verified.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = listed.join(weight, F.col("b") == F.col("w_node")).select(F.col("a").alias("node"), F.col("copies").alias("n")).unionByName(forest.select(F.col("a").alias("node"), "n"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n")).join(nodes.select("node", "copies"), "node", "full")
    counts = counts.select("node", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
    return members, verified.unionByName(forest.select("a", "b")), counts.join(nodes.select("node", "least"), "node")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Per document row: doc_id, k1, k2 (hashes of id and text), node (null without words), class_id, n_links."""
    members, edges, counts = links(docs, n, threshold, recall, small, block)
    labels = components(edges)
    roots = counts.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("root"), "n_links", "least")
    roots = materialize(roots, "roots")
    ids = roots.groupBy("root").agg(F.min("least").alias("class_id"))
    found = materialize(roots.join(ids, "root").select("node", "root", "class_id", "n_links"), "classes")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return members.join(found, "node", "left").select("doc_id", "k1", "k2", "root", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: one with the class's smallest doc_id.  Rows without words go only if they
    repeat another's id and text.

    Rows that may have to go, or that repeat, are shuffled; all others stay where they are.
    """
    k1, k2, gone, row = (free_name(docs, c) for c in ("k1", "k2", "gone", "row"))
    rooted = materialize(classes(docs, n, threshold).select("doc_id", "k1", "k2", "root"), "rooted")
    found = rooted.where("root IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k1", "k2"))
    kept = found.groupBy("root").agg(first.alias("kept"), F.count("*").alias("n")).where("n > 1").select("kept.k1", "kept.k2", F.col("root").alias("k_root"))
    # Every row of a class of several: those of the kept key become one, the others go.
    several = found.join(kept.select(F.col("k_root").alias("root"), F.col("k1").alias("kept1"), F.col("k2").alias("kept2")), "root")
    listed = several.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.max((F.col("k1") != F.col("kept1")) | (F.col("k2") != F.col("kept2"))).alias(gone), F.count("*").alias("n"))
    wordless = rooted.where("root IS NULL").groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.lit(False).alias(gone), F.count("*").alias("n"))
    listed = materialize(listed.unionByName(wordless).where(F.col(gone) | (F.col("n") > 1)).drop("n"), "listed")
    keyed = docs.withColumns(dict(zip((k1, k2), marks(docs["doc_id"], docs["text"]), strict=True)))
    maybe, rest = split(keyed, listed, k1)
    # Rows that share id and text are all listed, so nothing else is lost where a key becomes one row.
    once = maybe.groupBy(k1, k2).agg(F.first(F.struct(*columns(docs))).alias(row)).join(listed, [k1, k2], "left").where(f"NOT coalesce(`{gone}`, false)")
    return rest.select(*columns(docs)).unionByName(once.select(*[F.col(row)[c].alias(c) for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


ORACLE = r"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
gram AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
both_ AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM gram x JOIN gram y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN size s ON s.r = a JOIN size t ON t.r = b WHERE k >= 0.8 * (s.n + t.n - k) - 1e-9),
reach AS (SELECT DISTINCT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT a AS r, min(d.doc_id) AS least FROM reach JOIN words d ON d.r = reach.b GROUP BY a),
degree AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(least, doc_id)) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM words LEFT JOIN class USING (r) LEFT JOIN degree USING (r)
"""
