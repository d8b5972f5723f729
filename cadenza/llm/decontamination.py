"""Benchmark decontamination (native): broadcast hash set of test n-grams, scan of token windows, verified hits.

Every benchmark item is cut into windows of ``window`` consecutive words (an item of fewer words, but
not none, is one window).  The windows' 64-bit hashes form a broadcast table; each document's words are
hashed window by window inside generated code, probed against it, and a probe that hits is verified word
by word before it counts.  All hits of a document are gathered in the task that read it (partial
aggregation), so only one row per document is shuffled, however common a passage is.

A broadcast is bounded by ``max_broadcast_bytes``; a larger benchmark is dealt into as many hash classes as
needed, and each class is probed in a pass of its own.  A window that very many items share is several rows of
at most ``ITEMS_A_ROW`` items, so that classes are of even size.

Edge cases: null and empty texts have no words and no hits; repeated rows are reported once per row;
benchmark rows with null item_id or without words take no part; an empty benchmark contaminates
nothing; extra columns are ignored by ``report`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import WORD_ANY_CASE, columns, free_name, marks, materialize, split, table, word_array

WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20
ITEMS_A_ROW = 1000
#: Bytes of a row and of a string beside its characters, in a broadcast hash table.
_ROW_COST, _STRING_COST = 64, 24
#: A position code holds the window's length above this factor and its start below.
_BASE = 1 << 32


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, key, gram, items): each distinct window, with the ids of the items that have it, ``ITEMS_A_ROW`` a row."""
    words = bench.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("words"))
    sized = words.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window)))
    grams = sized.select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(words) - len + 1), i -> slice(words, i, len))")).alias("gram"))
    dealt = grams.withColumn("item_class", F.pmod(F.xxhash64("item_id"), F.lit(1 << 16)))
    # Items of a window are counted first; few windows have more than one row.
    parts = F.ceil(F.col("n") / ITEMS_A_ROW)
    counted = dealt.groupBy("len", "gram").agg(F.count("*").alias("n")).where(F.col("n") > ITEMS_A_ROW).select(F.col("len").alias("c_len"), F.col("gram").alias("c_gram"), parts.alias("parts"))
    dealt = dealt.join(counted, (F.col("len") == F.col("c_len")) & (F.col("gram") == F.col("c_gram")), "left").withColumn("part", F.pmod("item_class", F.coalesce("parts", F.lit(1))))
    return dealt.groupBy("len", "gram", "part").agg(F.collect_set("item_id").alias("items")).select("len", F.xxhash64("gram").alias("key"), "gram", "items")


def _position_codes(lengths: list[int]) -> Column:
    """0 (the document itself) and one code per window of the document, for each length in use."""
    parts = [F.array(F.lit(0).cast("long"))]
    for n in lengths:
        first = F.lit(n * _BASE + 1)
        parts.append(F.when(F.col("n_words") >= n, F.sequence(first, first + F.col("n_words") - n)).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*parts)


def _hits(words: DataFrame, keys: list[str], windows: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per document: keys, n_words, spans (start and length of each hit window) and items."""
    itself = words.sparkSession.createDataFrame([(0, 0, [], [])], windows.schema)
    probe = words.select(*keys, "n_words", "words", F.explode(_position_codes(lengths)).alias("code"))
    probe = probe.select(*keys, "n_words", "words", F.shiftright("code", 32).cast("int").alias("p_len"), F.col("code").bitwiseAND(F.lit(_BASE - 1)).cast("int").alias("p_start"))
    gram = F.slice("words", F.col("p_start"), F.col("p_len"))
    probe = probe.withColumn("p_key", F.when(F.col("p_len") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.slice("words", F.greatest("p_start", F.lit(1)), F.col("p_len")))))
    found = probe.join(F.broadcast(windows.unionByName(itself)), (F.col("p_key") == F.col("key")) & (F.col("p_len") == F.col("len")) & ((F.col("p_len") == 0) | (F.when(F.col("p_len") > 0, gram) == F.col("gram"))))
    span = F.when(F.col("p_len") > 0, F.struct(F.col("p_start").alias("start"), F.col("p_len").alias("len")))
    return found.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("p_len") > 0, F.col("items"))))).alias("items"))


def find_hits(docs: DataFrame, bench: DataFrame, keys: dict[str, Column], window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """For each document: the given key columns, n_words, spans and items of its verified hits."""
    windows = materialize(benchmark_windows(bench, window), "windows")
    # At most `window` lengths and one count: nothing here grows with either table.
    held = lambda strings: F.aggregate(strings, F.lit(0).cast("long"), lambda acc, x: acc + F.octet_length(x) + _STRING_COST)
    stats = windows.agg(F.sum(held("gram") + held("items") + _ROW_COST).alias("bytes"), F.sort_array(F.collect_set("len")).alias("lengths")).first()
    lengths, passes = list(stats["lengths"]), max(1, -(-(stats["bytes"] or 0) // max_broadcast_bytes))
    words = docs.select(*[c.alias(k) for k, c in keys.items()], word_array(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    if passes == 1:
        return _hits(words, list(keys), windows, lengths)
    words = materialize(words, "doc-words")
    found = [_hits(words, list(keys), windows.where(F.pmod(F.xxhash64("key", F.get("items", F.lit(0))), F.lit(passes)) == i), lengths) for i in range(passes)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def covered_words() -> Column:
    """Words inside any span: the length of the union of the spans, in start order."""
    return F.expr(
        "aggregate(array_sort(spans), named_struct('upto', 0, 'n', 0L), (acc, s) -> named_struct('upto', greatest(acc.upto, s.start + s.len - 1),"
        " 'n', acc.n + greatest(s.start + s.len - 1 - greatest(acc.upto, s.start - 1), 0)), acc -> acc.n)"
    )


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and item_ids."""
    hits = find_hits(docs, bench, {"row": F.monotonically_increasing_id(), "doc_id": F.col("doc_id")}, window, max_broadcast_bytes)
    items = F.array_sort("items")
    return hits.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (``remove='documents'``), or with the hit words cut out of their texts (``'spans'``).

    Rows are matched by two hashes of id and text.  Only rows that may hold a hit are shuffled; all others stay
    where they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r}")
    k1, k2, spans, gaps, kept = (free_name(docs, c) for c in ("k1", "k2", "spans", "gaps", "kept"))
    keys = dict(zip((k1, k2), marks(docs["doc_id"], docs["text"]), strict=True))
    hits = find_hits(docs, bench, keys, window).where(F.size("spans") > 0)
    hits = materialize(hits.select(k1, k2, F.col("spans").alias(spans)), "hits")
    maybe, rest = split(docs.withColumns(keys), hits, k1)
    if remove == "documents":
        return rest.unionByName(maybe.join(hits, [k1, k2], "left_anti")).select(*columns(docs))
    # What stands between the words stays; a hit word becomes nothing.
    cut = F.expr(
        f"array_join(zip_with(sequence(0, size({gaps}) - 1), {gaps}, (i, gap) -> concat(gap, CASE WHEN i < size({kept})"
        f" AND NOT exists({spans}, s -> i + 1 BETWEEN s.start AND s.start + s.len - 1) THEN {kept}[i] ELSE '' END)), '')"
    )
    marked = maybe.join(hits, [k1, k2], "left")
    marked = marked.withColumns({gaps: F.split("text", WORD_ANY_CASE), kept: F.regexp_extract_all("text", F.lit(WORD_ANY_CASE), F.lit(0))})
    cleaned = marked.select(*[F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return rest.select(*columns(docs)).unionByName(cleaned)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
gram AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item)),
win AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM gram))),
hit AS (SELECT r, i, win.n, item_id FROM win JOIN gram ON win.n = gram.n AND win.g = gram.g),
spot AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
who AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN spot USING (r) LEFT JOIN who USING (r)
"""
