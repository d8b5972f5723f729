"""Steps that most queries share: what they shuffle."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from cadenza import registry
from cadenza.operators import islands as I
from cadenza.operators import library as L
from cadenza.operators import ordered
from cadenza.queries import flows
from cadenza.queries.standin import Inputs
from cadenza.sources import readers
from cadenza.sources.sinks import staged

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def test_the_lines_are_searched_once_for_the_declaration(spark):
    inputs = Inputs(spark, DATA)
    assert inputs.declared is inputs.declared and not any("lineitem" in f for f in inputs.declared.inputFiles())
    assert inputs.declared.count() == inputs.declared.distinct().count() > 0


def test_plays_are_counted_by_keys_and_get_the_same_ids(spark):
    inputs = Inputs(spark, DATA)
    rows = lambda df: sorted(map(tuple, df.select("user_id", "mbid", "plays").collect()))
    assert rows(inputs.counted()) == rows(L.count_plays(inputs.listens, plays="n"))
    assert rows(inputs.counted(F.col("n") > 20)) == rows(L.count_plays(inputs.listens.where("n > 20"), plays="n"))
    plan = inputs.counted()._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("md5") < plan.index("Aggregate")  # ids are made above the count


def test_the_library_lies_by_keys_and_its_parts_are_those_of_all_lines(spark):
    inputs = Inputs(spark, DATA)
    rows = lambda df: sorted(map(tuple, df.collect()))
    held = spark.read.parquet(os.path.dirname(inputs.library.inputFiles()[0]))
    assert "string" not in dict(held.dtypes).values()  # ids are made of keys when they are read
    named = L.count_plays(inputs.listens, plays="n")
    assert rows(inputs.library) == rows(named)
    recording = L.surrogate_keys(named)
    assert rows(inputs.recording) == rows(recording)
    assert rows(inputs.user_plays) == rows(L.user_plays(named, recording, inputs.pool))
    assert rows(inputs.recording_artist) == rows(L.artist_bridge(inputs.listens, recording))


def test_lines_are_counted_by_parts_before_they_get_ids(spark):
    for name in ("join_inner_mbid_text", "filter_list_not_null"):
        top, *below = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert "count(1)" not in top and any("count(1)" in line for line in below), name  # what is counted has no ids yet
    inputs = Inputs(spark, DATA)
    want = inputs.listens.select("recording_mbid", F.explode("artist_credit_mbids")).distinct()
    assert sorted(map(tuple, registry.queries()["fn_unnest"](spark, DATA).collect())) == sorted(map(tuple, want.collect()))


def test_what_a_range_takes_over_moves_no_rows(spark, tmp_path):
    """Offsets of ranges are joined to lines where these lie, whatever Spark thinks of the sizes."""
    heads = [n for n in range(3000) if n % 7 == 0]
    text = [str(1_600_000_000 + n) if n % 7 == 0 else f'+  (s: "{uuid.UUID(int=n)}", q: 3),' if n % 7 < 5 else "+++ b/list" for n in range(3000)]
    (tmp_path / "log.txt").write_text("\n".join(text))
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        found = readers.git_log_file(spark, str(tmp_path / "log.txt"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.select("commit", "at", "line", "mbid").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan
    want = [(max(h for h in heads if h <= n), 1_600_000_000 + n // 7 * 7, n, str(uuid.UUID(int=n))) for n in range(3000) if 0 < n % 7 < 5]
    assert sorted(map(tuple, rows)) == want


def test_a_longer_log_has_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(flows, "LOG_LINES", 500)
    log = flows._log(Inputs(spark, DATA), F.concat(F.lit("e"), F.col("l_partkey").cast("string")))
    assert log.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_many = sorted(map(tuple, registry.queries()["win_first_added"](spark, DATA).collect()))
    monkeypatch.undo()
    assert by_many == sorted(map(tuple, registry.queries()["win_first_added"](spark, DATA).collect()))


def test_more_rows_are_more_tasks_and_the_same_results(spark, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()))
    few = Inputs(spark, DATA)
    monkeypatch.setattr(ordered, "TASK_ROWS", 500)
    many = Inputs(spark, DATA)
    tasks = -(-many.lines // 500)
    assert tasks > spark.sparkContext.defaultParallelism
    assert many._bought.rdd.getNumPartitions() == many._keyed().rdd.getNumPartitions() == tasks
    assert many.drawn.rdd.getNumPartitions() == -(-many.user_plays.count() // 500)
    for part in ("library", "declared", "recording", "user_plays", "user_stat", "drawn", "recording_listener"):
        assert rows(getattr(many, part)) == rows(getattr(few, part)), part
    assert rows(I.ranked(many.best, 20).select("island", "position", "mbid")) == rows(I.ranked(few.best, 20).select("island", "position", "mbid"))


def test_plays_are_dealt_once_for_statistics_and_not_at_all_for_few(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 500)
    inputs = Inputs(spark, DATA)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(L.user_stat(inputs.user_plays)).count("Exchange hashpartitioning") == 1
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")  # as files the few are smaller, by a guess at a join larger
        heard = I.audience(inputs.user_plays, inputs.user_stat, inputs.recording, inputs.declared)
        assert "hashpartitioning(recording_id" not in plan(heard)
        assert "SortMergeJoin" not in plan(inputs.vote)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ids_of_listens_are_shuffled_once(spark, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()))
    inputs = Inputs(spark, DATA)
    listens = staged(inputs.listens.select("user_id", F.when(F.col("part") % 13 != 0, F.col("recording_mbid")).alias("recording_mbid")), "listens")
    recording = staged(L.surrogate_keys(L.count_plays(listens)), "recording")
    want = rows(L.count_plays(listens).join(recording, "mbid").select("user_id", "recording_id", "plays"))
    assert rows(L.count_numbered(listens, recording)) == want
    monkeypatch.setattr(ordered, "TASK_ROWS", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = L.count_numbered(listens, recording)
        # One exchange of the listens, one of the recordings.
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows(found) == want
    dump = Inputs(spark, DATA).dump
    assert dump.rdd.getNumPartitions() == -(-inputs.lines // 500)
    assert rows(dump.select("user_id", "recording_mbid", "artist_credit_mbids", "part")) == rows(inputs.listens.select("user_id", "recording_mbid", "artist_credit_mbids", "part"))


def test_builds_over_dealt_listens_are_the_same(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, registry.queries()["invalidate_on_stamp"](spark, DATA).collect()))
    few = rows()
    monkeypatch.setattr(ordered, "TASK_ROWS", 500)
    assert rows() == few
