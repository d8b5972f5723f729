"""Toxicity where toxic labels are few or rare: the classifier still decides, by text."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cadenza.llm import toxicity
from cadenza.llm.common import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rare(spark, clean, toxic):
    """``toxic`` documents with insults behind ``clean`` ones without, and their labels."""
    texts = [" ".join(f"word{(i * 7 + k * k) % 90}" for k in range(30 + i % 9)) for i in range(clean + toxic)]
    texts = [t if i < clean else f"{t} you idiot shut up l0ser!!" for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") >= clean).cast("int").alias("toxic"))


@pytest.mark.parametrize(("clean", "toxic", "most"), [(60, 12, 20_000), (900, 40, 200)])
def test_few_and_rare_toxic_rows_still_train(spark, clean, toxic, most):
    docs, labels = rare(spark, clean, toxic)
    scores = {r["doc_id"]: r["score"] for r in toxicity.train(docs, labels, most).score(docs).collect()}
    assert all(scores[i] >= toxicity.THRESHOLD for i in range(clean, clean + toxic))
    assert sum(scores[i] >= toxicity.THRESHOLD for i in range(clean)) <= clean // 50


def test_one_row_of_each_class_and_one_class_alone(spark):
    docs, labels = rare(spark, 3, 3)
    used = labels.where(~toxicity.held_out(F.col("doc_id")))
    pair = used.where("toxic = 0").limit(1).unionByName(used.where("toxic = 1").limit(1))
    assert toxicity.report(docs, pair).count() == 6
    for y in (0, 1):
        assert {r["score"] for r in toxicity.report(docs, used.where(F.col("toxic") == y)).collect()} == {float(y)}


def test_capital_share_counts_every_capital():
    at = toxicity.FEATURES.index("capital_share")
    assert toxicity.features("Aaa bBb Ccc Aaa", {}, {})[at] == 4 / 15


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_smallest_tables_lose_toxic_documents(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    kept = {r["doc_id"] for r in toxicity.keep(docs, labels).select("doc_id").collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    toxic, clean = ([d for d, y in known.items() if y == want] for want in (1, 0))
    assert sum(d in kept for d in toxic) <= len(toxic) // 4
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)
