"""The pipeline's stages, their columns and decisions, against what the operators say one by one."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from cadenza.llm import registry
from cadenza.llm.common import materialize, table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def test_stages_keep_columns_and_decide(spark):
    from cadenza.llm import decontamination, ngram_jaccard

    docs = table(spark, DATA, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "ngram_jaccard":
            classes = ngram_jaccard.classes(before).collect()
            assert {r["doc_id"] for r in docs.collect()} == {r["class_id"] for r in classes}
        if name == "decontamination":
            found = {r["doc_id"]: r["contaminated"] for r in decontamination.report(before, table(spark, DATA, "benchmark")).collect()}
            assert {r["doc_id"] for r in docs.collect()} == {d for d, bad in found.items() if not bad}
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert placed.count() == counts[4]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, relation = registry.queries()[name](spark, DATA), connection.sql(registry.oracle_sql()[name])
    assert sorted(map(repr, map(tuple, df.select(*relation.columns).collect()))) == sorted(map(repr, relation.fetchall()))


def test_stages_take_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Null ids, texts and sources, empty texts, rows that repeat, rows that differ in one column, odd column names."""
    from pyspark.sql import functions as F

    prose = [f"plain words number {k} stand here in a row of their own kind {k * 7}" for k in range(12)]
    item = "this passage of ten words or more belongs to the benchmark alone"
    rows = [(k, t, "en", "a" if k % 2 else "b", len(t)) for k, t in enumerate(prose)]
    rows += [(20, f"before {item} after", "en", "a", 9), (21, None, "en", "a", 0), (22, "", None, None, 0), (None, "words of nobody in particular stand here alone", "en", "b", 5)]
    rows += [rows[3], rows[3], (3, rows[3][1], "fr", rows[3][3], rows[3][4]), (30, rows[5][1], "en", "a", 1), (31, "one more text " * 4000, "en", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("k1", "k2", "mark", "flag", "cell", "bitmap", "row", "values", "vector", "score", "prediction", "probability", "node", "base", "extra", "size", "usual", "mix_n", "gone", "a.b")})
    labels = spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    left, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = materialize(stage(spark, left, str(tmp_path)), f"odd-{name}")
        assert left.columns == columns, name
        ids.append(sorted((r["doc_id"] for r in left.select("doc_id").collect()), key=repr))
    toxic, once, clean, mixed = ids
    assert len(toxic) == len(rows)
    # Repeats of row 3 and the copy of row 5 go; wordless rows and the row without id stay.
    assert once == sorted([*range(12), 20, 21, 22, None, 31], key=repr)
    assert clean == sorted([*range(12), 21, 22, None, 31], key=repr)
    assert set(mixed) <= set(clean) - {21, 22}
    assert corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).count() == len(mixed)


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
