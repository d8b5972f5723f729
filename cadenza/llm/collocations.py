"""Phrase collocations: n-grams as DataFrame rows, counted per language, scored at their weakest cut.

Every text is lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into words.  All
1..max_n-grams of all pieces become rows and are counted by hash aggregation, which combines within each task
before anything is shuffled; of the longer ones, rows that hold a phrase too rare are dropped before that.  A phrase of at least ``min_count`` occurrences is cut after each of its first
words; prefix and suffix counts are joined to it, and the cut with the lowest score
``floor(1000000 * a * a / (l * r))`` counts.  Products are decimals of 38 digits: exact for counts below 1e16,
an error beyond.  A phrase is dropped if a phrase one word longer that holds it occurs in at least
``absorb_percent`` of its places; longer ones need no look, since one between the two occurs at least as often.
Each language's ``top`` phrases are taken first within hash classes, then among what those leave.

Edge cases: null and empty texts have no words; a null language is ``und``, and so counts together with texts
that say ``und``; repeated rows count once per row; a language without phrases has no rows, an empty table none
at all; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize, sieve, table

MAX_N, MIN_COUNT, ABSORB_PERCENT, TOP = 3, 10, 50, 2000
#: Capitals become small letters, every end of a piece a line feed, and every blank a space.
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ".,;:!?\x0b\x0c\r" + "\t"
_TO = "abcdefghijklmnopqrstuvwxyz" + "\n" * 9 + " "
SCALE = 1_000_000
#: Digits of a count: two counts and the scale multiplied fit 38 digits.
_COUNT = "decimal(16,0)"
_CLASSES = 64


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, words): the words of each piece that has any."""
    # One pass over the characters; what it leaves is split at single characters, which needs no pattern.
    text = F.translate("text", _FROM, _TO)
    split = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, "\n")).alias("piece")).where(F.col("piece") != "")
    return split.select("lang", F.array_remove(F.split("piece", " "), "").alias("words")).where(F.size("words") > 0)


def _grams(docs: DataFrame, *sizes: int) -> DataFrame:
    """(lang, words, start, size): a row for each phrase of the given sizes, and one of size 0 for the whole piece."""
    n_words, n = F.size("words"), len(sizes)
    # A phrase's number is start * n + the place of its size; -1 stands for the piece.
    spots = pieces(docs).select("lang", "words", F.explode(F.sequence(F.lit(-1), n_words * n - 1)).alias("spot"))
    size = F.when(F.col("spot") < 0, 0)
    for place, s in enumerate(sizes):
        size = size.when(F.col("spot") % n == place, s)
    spots = spots.select("lang", "words", F.call_function("div", F.col("spot"), F.lit(n)).cast("int").alias("start"), size.alias("size"))
    return spots.where(F.col("start") + F.col("size") <= n_words)


def _counted(grams: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, f); the phrase of no words counts words."""
    phrase = F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " ")
    times = F.when(F.col("size") == 0, F.size("words")).otherwise(1).cast("long")
    counted = grams.select("lang", phrase.alias("phrase"), times.alias("times")).groupBy("lang", "phrase").agg(F.sum("times").alias("f"))
    return counted.where((F.col("f") >= min_count) | (F.col("phrase") == ""))


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, size, phrase, f): words and phrases of at least ``min_count`` occurrences, and, as the phrase of no
    words, each language's number of words.

    Of the phrases of three words and more, those that hold a rarer phrase one word shorter are no candidates;
    a sieve of fixed size keeps most of them from the shuffle.
    """
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    levels = [materialize(_counted(_grams(docs, *range(1, min(max_n, 2) + 1)), min_count).withColumn("size", size), "phrases")]
    for n in range(3, max_n + 1):
        shorter = levels[-1].where(F.col("size") == n - 1).select(F.xxhash64("lang", F.split("phrase", " ")).alias("key"))
        grams = _grams(docs, n).where(F.col("size") == n)
        for column, first in (("head", 1), ("tail", 2)):
            keyed = grams.withColumn(column, F.xxhash64("lang", F.slice("words", F.col("start") + first, n - 1)))
            grams = sieve(keyed, shorter.withColumnRenamed("key", column), column)
        levels.append(materialize(_counted(grams, min_count).withColumn("size", size), "phrases"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every


def weakest_cuts(counts: DataFrame) -> DataFrame:
    """Each phrase of two words or more (lang, size, phrase, a) with l, r, score and k of its lowest-scoring cut."""
    words = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    cuts = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    of = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), "f")
    # A part occurs wherever its phrase does, so none was too rare to be kept.
    cuts = cuts.join(of.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(of.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    return cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score", "cut.k")


def _score(a: Column, left: Column, right: Column) -> Column:
    """The floored score: never above SCALE, since no part occurs less often than the phrase."""
    a, left, right = (x.cast(_COUNT) for x in (a, left, right))
    over = (F.lit(SCALE).cast("decimal(7,0)") * (a * a)).cast("decimal(38,0)")
    return F.call_function("div", over, (left * right).cast("decimal(38,0)")).cast("long")


def absorbed(counts: DataFrame, percent: int = ABSORB_PERCENT) -> DataFrame:
    """(lang, phrase) of phrases that a phrase one word longer holds in at least ``percent`` of their places."""
    words = F.split("phrase", " ")
    inner = F.array(*[F.array_join(F.slice(words, first, F.col("size") - 1), " ") for first in (1, 2)])
    longer = counts.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = counts.where("size > 1").join(longer, ["lang", "phrase"])
    return held.where(F.col("longer").cast(_COUNT) * 100 >= F.col("f").cast(_COUNT) * percent).select("lang", "phrase")


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, absorb_percent: int = ABSORB_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score, a (both descending) and phrase."""
    counts = phrase_counts(docs, max_n, min_count)
    kept = weakest_cuts(counts).join(absorbed(counts, absorb_percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = kept.withColumn("class", F.pmod(F.xxhash64("phrase"), F.lit(_CLASSES)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "class").orderBy(*order))).where(F.col("rank") <= top)
    best = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH piece AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
spot AS (SELECT p, lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
gram AS (SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM spot, range(1, 4) AS sizes(s) WHERE i + s - 1 <= len(w)),
f AS (SELECT lang, s, phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang),
cand AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE s > 1 AND f >= 10),
cut AS (SELECT lang, c.phrase, a, k, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, s)) AS k FROM cand) c
  JOIN f x USING (lang) JOIN f y USING (lang)
  WHERE x.phrase = array_to_string(c.w[1:c.k], ' ') AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN f g ON c.lang = g.lang AND g.s = 3 AND g.f >= 10 AND c.s = 2
  AND (c.phrase = array_to_string(string_split(g.phrase, ' ')[1:2], ' ') OR c.phrase = array_to_string(string_split(g.phrase, ' ')[2:3], ' ')) AND 100 * g.f >= 50 * c.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM low ANTI JOIN held USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
