"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Training rows are labelled documents outside the held-out fifth, at most about ``MAX_TRAIN`` of them, taken
by a hash of their id, class by class: each class may fill half of them and what the other leaves, and weights
restore the classes' shares.  They are dealt into ``FOLDS`` folds, class by class, and every step is cross-fitted, at
every size alike, so that no step is fitted on what the step before has seen:

1.  a lexicon: words and word stems whose document frequency in toxic rows is far above that in others; a fold's
    rows are valued by what the other folds' rows teach, documents to be scored by what all teach;
2.  boosted trees over the features of ``FEATURES``, fitted on all rows so valued;
3.  an isotonic map to the share of toxic rows, from what trees of the other folds say of each fold.

Features of a text: densities of the learned and of a fixed lexicon, nearness of hits to second-person
pronouns, capitals, punctuation and obfuscation (signs or digits inside words, letters set apart,
stretched letters).  They are computed from whole texts in Arrow batches; ids, labels, lang and source
are never inputs.

Edge cases: null and empty texts have zero features and are scored like any text; repeated label rows
count once, as toxic if any says so; rows with null doc_id count as held out and are never learned;
without labels, or with training rows of one class only, every score is the share of toxic training rows
(0 without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize, table

MAX_TRAIN = 20_000
HELD_OUT = 5
FOLDS = 2
LEXICON_TERMS = 600
MIN_RATIO = 8.0
STEMS = (4, 5, 6)
TREES, DEPTH, SEED = 30, 4, 17
THRESHOLD = 0.5
RAW_SHARE = 0.02
FEATURES = [
    "hits", "hit_density", "best_weight", "weight_density", "fixed_density", "near_you", "you_density", "capital_words", "capital_share",
    "exclaims", "punctuation", "obfuscated", "spaced_letters", "stretched", "log_words",
]

#: Common English insults, second-person pronouns of four languages, signs that stand for letters.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash garbage disgusting clown fool imbecile jerk hate kill ugly filth vermin shut liar coward".split())
YOU = frozenset("you your yours yourself u ur ya tu te toi ton ta vous votre du dich dir dein deine ihr euch usted tus ti vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`.,;:!?()[]{}<>*#&%$-_+=~|/\\“”„«»…"
_SPACED = re.compile(r"(?<!\S)\w(?:[ .\-*]\w){2,}(?!\S)")
_STRETCHED = re.compile(r"(\w)\1\1")
_PUNCTUATION = re.compile(r"[!?*#$%&@]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def plain(token: str) -> tuple[str, bool]:
    """The token in lower case without signs at its ends, and whether signs or digits hid letters in it."""
    word = token.strip(_EDGE).lower()
    if word.isalpha() or not any(c.isalpha() for c in word) or len(word) > 24:
        return word, False
    clear = "".join(c for c in word.translate(LEET) if c.isalpha())
    return clear, 3 * len(clear) >= 2 * len(word)


def _terms(text: str) -> set[str]:
    out = set()
    for token in set(text.split()):
        word, _ = plain(token)
        if len(word) > 1:
            out.add(word)
            out.update(word[:k] + "-" for k in STEMS if len(word) > k)
    return out


def _term_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen[toxic].update(_terms(text or ""))
        for toxic, counts in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([toxic] * len(counts), pa.int32()), pa.array(counts.values(), pa.int64())], ["term", "toxic", "n"])


def learn_lexicon(rows: DataFrame, sizes: dict[int, int], terms: int = LEXICON_TERMS, min_ratio: float = MIN_RATIO) -> dict[str, float]:
    """Terms with the log ratio of their document frequencies; at most ``terms`` of them reach the driver."""
    counts = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_term_counter, "term string, toxic int, n long")
    both = counts.groupBy("term").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    ratio = ((F.col("n1") + 0.5) / (sizes[1] + 1)) / ((F.col("n0") + 0.5) / (sizes[0] + 1))
    least = max(4, math.ceil(0.002 * sizes[1]))
    ranked = both.where(F.col("n1") >= least).withColumn("ratio", ratio).where(F.col("ratio") >= min_ratio)
    best = ranked.orderBy(F.desc(F.col("n1") * F.ln("ratio")), "term").limit(terms)
    return {r["term"]: math.log(r["ratio"]) for r in best.collect()}


def features(text: str | None, lexicon: dict[str, float], known: dict[str, tuple[float, bool, bool, bool, int]]) -> list[float]:
    """One value per name of FEATURES.  ``known`` remembers what tokens are worth."""
    text = text or ""
    tokens = text.split()
    n = max(1, len(tokens))
    hits = fixed = you = hidden = capital = capitals = 0
    best = total = 0.0
    marks: set[str] = set()
    yours: set[str] = set()
    for token, k in Counter(tokens).items():
        facts = known.get(token)
        if facts is None:
            word, masked = plain(token)
            weight = max([lexicon.get(word, 0.0), *(lexicon.get(word[:c] + "-", 0.0) for c in STEMS if len(word) > c)])
            facts = weight, word in INSULTS, word in YOU, masked, sum(map(str.isupper, token))
            if len(known) < 500_000:
                known[token] = facts
        weight, insult, second, masked, upper = facts
        if weight or insult:
            hits += k
            best = max(best, weight)
            total += k * weight
            fixed += k * insult
            marks.add(token)
        if second:
            you += k
            yours.add(token)
        hidden += k * masked
        capital += k * (token.isupper() and len(token) > 1)
        capitals += k * upper
    near = 0
    if marks and yours:
        last = -99
        open_: list[int] = []
        for i, token in enumerate(tokens):
            if token in yours:
                near += sum(i - p <= 4 for p in open_)
                open_, last = [], i
            elif token in marks:
                if i - last <= 4:
                    near += 1
                else:
                    open_.append(i)
    letters = max(1, len(text))
    return [
        float(hits), hits / n, best, total / n, fixed / n, near / n, you / n, capital / n, capitals / letters,
        text.count("!") / n, len(_PUNCTUATION.findall(text)) / n, hidden / n, len(_SPACED.findall(text)) / n, len(_STRETCHED.findall(text)) / n, math.log1p(len(tokens)),
    ]


def _featurer(lexicon: dict[str, float], dropped: str | None):
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            values = [features(t.as_py(), lexicon, known) for t in batch.column("text")]
            names = batch.schema.names
            kept = [i for i, name in enumerate(names) if name != dropped]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(values, pa.list_(pa.float64()))], [*(names[i] for i in kept), "values"])

    return featured


def with_features(rows: DataFrame, lexicon: dict[str, float], keep_text: bool = False) -> DataFrame:
    """``rows`` with ``values`` behind its columns, or in place of its text."""
    from pyspark.sql import types as T

    kept = [f for f in rows.schema if keep_text or f.name != "text"]
    return rows.mapInArrow(_featurer(lexicon, None if keep_text else "text"), T.StructType([*kept, T.StructField("values", T.ArrayType(T.DoubleType()))]))


class Model:
    """A lexicon, trees and a calibration, or a constant where a class has no labels."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, keep_text: bool = False) -> DataFrame:
        """``docs`` with ``score``, and without text unless ``keep_text``.  Columns must not bear Spark ML's names.

        The isotonic map has steps, on which all rows would score alike; a small share of the trees' own
        probability keeps their order.
        """
        names = [c for c in docs.columns if keep_text or c != "text"]
        if self.trees is None:
            return docs.select(*names).withColumn("score", F.lit(self.constant))
        raw = _raw(self.trees, with_features(docs, self.lexicon, keep_text).withColumn("vector", array_to_vector("values")))
        step = F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))
        return self.calibration.transform(raw).select(*names, ((1 - RAW_SHARE) * step + RAW_SHARE * F.col("raw")).alias("score"))


def _raw(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("prediction", "probability", "rawPrediction")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = SEED) -> Model:
    """Fit on at most about ``max_train`` labelled rows that are not held out."""
    truth = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    steps = 1_000_000
    size = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in truth.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bound = {y: max(max_train // 2, max_train - size[1 - y]) for y in (0, 1)}
    share = {y: max(1, min(steps, int(steps * bound[y] / max(1, size[y])))) for y in (0, 1)}
    of_class = lambda x: F.when(F.col("toxic") == 1, F.lit(x[1])).otherwise(F.lit(x[0]))
    truth = truth.where(F.pmod(F.xxhash64("l_id", F.lit(seed)), F.lit(steps)) < of_class(share)).withColumn("weight", of_class({y: steps / share[y] for y in (0, 1)}))
    # About ``max_train`` ids at most, whatever the input: broadcast, so that no text is shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(truth), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic", "weight")
    # The sample is bounded, so one task can number a class; classes start at different folds, so that none is left without rows.
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))
    rows = materialize(rows.withColumn("fold", (place + F.col("toxic")) % FOLDS), "toxic-train")
    n = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    count = lambda y, without=None: sum(v for (fold, toxic), v in n.items() if toxic == y and fold != without)
    if not min(count(0), count(1)):
        return Model({}, constant=float(count(1) > 0))
    taught = [learn_lexicon(rows.where(F.col("fold") != k), {y: count(y, k) for y in (0, 1)}) for k in range(FOLDS)]
    valued = None
    for k, lexicon in enumerate(taught):
        part = with_features(rows.where(F.col("fold") == k), lexicon)
        valued = part if valued is None else valued.unionByName(part)
    valued = materialize(valued, "toxic-values").withColumn("vector", array_to_vector("values"))
    leaf, raw = max(1, min(10, min(count(0), count(1)) // 4)), None
    for k in range(FOLDS):
        told = _raw(_fit_trees(valued.where(F.col("fold") != k), seed, leaf), valued.where(F.col("fold") == k)).select("raw", "toxic", "weight")
        raw = told if raw is None else raw.unionByName(told)
    return Model(learn_lexicon(rows, {y: count(y) for y in (0, 1)}), _fit_trees(valued, seed, leaf), _fit_scale(raw))


def _fit_trees(rows: DataFrame, seed: int, leaf: int):
    # The sample is bounded, so a few partitions hold it.
    learnt = rows.coalesce(4).cache()
    trees = GBTClassifier(featuresCol="vector", labelCol="toxic", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=leaf, seed=seed).fit(learnt)
    learnt.unpersist()
    return trees


def _fit_scale(raw: DataFrame):
    return IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(raw.select("raw", F.col("toxic").cast("double").alias("label"), "weight"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without documents that score ``threshold`` or more: one pass, in which each row is judged where it is read."""
    # Renamed by place, so that no extra column meets a name that the model uses.
    inner = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    scored = train(docs, labels).score(docs.toDF(*inner), keep_text=True).where(F.col("score") < threshold)
    return scored.select(*inner).toDF(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    scored = train(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
