"""Line dedup (native): lines spread over many sites are boilerplate.

Lines are hashed; per line hash a HyperLogLog sketch of the sites is built by partial aggregation and
merged, so a line found in every document costs one small sketch per task.  Lines whose estimate is
clearly above or below ``min_sites`` are decided by it; lines near the threshold get exact distinct
counts from (line, site) pairs.  Boilerplate lines are then removed from every document.

Texts stay where they are unless they may hold such a line: a sieve of fixed size passes those, and only
their (text, line) hashes are shuffled to meet the boilerplate.  The positions that go come back to the texts
by one join.  A line or a text of very many rows is reduced to one row per task before each shuffle.

Lines are compared after trimming blanks; blank lines are kept and never counted.  Two 64-bit hashes name
a line, and a text.

Edge cases: null texts stay null and have no lines; null sites are one site; repeated rows do not add
sites; extra columns are ignored by ``report`` and kept by ``remove``; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import free_name, marks, materialize, sieve, split, table

MIN_SITES = 10
LG_K = 10
#: Standard errors of the sketch (1.04 / sqrt(2 ** LG_K)) within which a line counts as near the threshold.
ERRORS = 5


def _lines(docs: DataFrame, *keys: Column | str) -> DataFrame:
    """(keys, pos, h1, h2) of every line that is not blank."""
    parts = docs.select(*keys, F.split("text", "\n").alias("parts")).select("*", F.posexplode("parts").alias("pos", "line")).drop("parts")
    named = parts.withColumn("line", F.trim("line")).where("line <> ''")
    return named.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))}).drop("line")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, sites): the lines found on at least ``min_sites`` sites."""
    named = _lines(docs, F.coalesce("source", F.lit("")).alias("site")).drop("pos")
    spread = named.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    band = max(1.0, ERRORS * 1.04 / 2 ** (LG_K / 2) * min_sites)
    spread = materialize(spread.where(F.col("sites") >= min_sites - band), "line-spread")
    near = spread.where(F.col("sites") <= min_sites + band).select("h1", "h2")
    # One row per line and site before the join: a line near the threshold has few sites, however often it occurs.
    pairs = sieve(named, near, "h1").distinct()
    exact = pairs.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return materialize(exact.unionByName(spread.where(F.col("sites") > min_sites + band)), "boilerplate")


def _cut(docs: DataFrame, removed: str, min_sites: int) -> DataFrame:
    """``docs`` with ``removed``: the positions of its boilerplate lines, null where there are none."""
    common = boilerplate(docs, min_sites).select("h1", "h2")
    k1, k2 = (free_name(docs, c) for c in ("k1", "k2"))
    keyed = docs.withColumns(dict(zip((k1, k2), marks("text"), strict=True)))
    # What is to go follows from the text alone, so equal texts ask once.
    asked = sieve(_lines(keyed, F.col(k1).alias("k1"), F.col(k2).alias("k2")), common, "h1").distinct()
    found = asked.join(common, ["h1", "h2"]).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.array_sort(F.collect_list("pos")).alias(removed))
    found = materialize(found, "removed-lines")
    maybe, rest = split(keyed, found, k1)
    return rest.withColumn(removed, F.lit(None).cast("array<int>")).unionByName(maybe.join(found, [k1, k2], "left")).drop(k1, k2)


def _kept(removed: str) -> Column:
    """The text of the lines that stay; null texts stay null."""
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(removed))
    return F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))


def remove(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines cut out of their texts."""
    removed = free_name(docs, "removed")
    cut = _cut(docs, removed, min_sites)
    return cut.select(*[_kept(removed).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per document row: doc_id, n_lines, n_removed, kept_sha256 (of the remaining text)."""
    cut = _cut(docs.select("doc_id", "source", "text"), "removed", min_sites)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_removed = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long")
    return cut.select("doc_id", n_lines.alias("n_lines"), n_removed.alias("n_removed"), F.sha2(F.coalesce(_kept("removed"), F.lit("")), 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS parts FROM documents),
line AS (SELECT r, site, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM doc),
common AS (SELECT trim(line, ' ') AS line FROM line WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
kept AS (SELECT r, count(*) AS n_lines, count(c.line) AS n_removed, string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE c.line IS NULL) AS kept
         FROM line l LEFT JOIN common c ON trim(l.line, ' ') = c.line GROUP BY r)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
"""
