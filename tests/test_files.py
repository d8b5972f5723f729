"""Declarations in full, numbered lines over byte ranges, and files packed by size."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import outliers as O
from cadenza.sources import readers, sinks

A, B = "0f5f7a3e-0000-4000-8000-00000000000a", "0f5f7a3e-0000-4000-8000-00000000000b"


def test_declarations_in_every_spelling():
    text = f"""#![enable(implicit_some, unwrap_newtypes)] /* outer /* inner */ still */ [
    Entry(s: r#"{A.upper()}"#, q: 0x2, playlist: [r"a\\b", "\\x41\\u{{1F642}}\\"\\n"]), // end
    (playlist: [], q: +1, r#s: "{B.replace('-', '')}",),
    ( s : "urn:uuid:{B[:-1]}c" , q : 0b1_1 , playlist : [ ] ) , (s: "{{{A[:-1]}d}}", q: 0o4, playlist: [r##"x"#y"##,])]"""
    assert readers.parse_declaration(text, needs_playlist=True) == [(A, 2, ["a\\b", 'A\U0001f642"\n']), (B, 1, []), (B[:-1] + "c", 3, []), (A[:-1] + "d", 4, ['x"#y'])]


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        (f'[(s: "{A}", q: 1)]', "missing field playlist"),
        (f'[(s: "{A}", q: -1, playlist: [])]', "out of range"),
        (f'[(s: "{A}", q: 1.0, playlist: [])]', "unexpected character"),
        (f'[(s: "{A}", q: 1_0, playlist: [])]', "out of range"),
        (f'[Other(s: "{A}", q: 1, playlist: [])]', "expected Entry"),
        (f'[(s: "{A}", q: 1, playlist: ["\\q"])]', "unknown escape"),
        (f'[(s: "{A}", q: 1, playlist: ["\\u{{D800}}"])]', "no character"),
        ("#![enable(magic)] []", "unknown extension"),
        ("/* /* */ []", "comment without an end"),
        ('[r#"x"]', "text without an end"),
        (f'[(s: "{A[:-1]}", q: 1, playlist: [])]', "no id"),
        (f'[(s: "{{{A.replace("-", "")}}}", q: 1, playlist: [])]', "no id"),
    ],
)
def test_what_is_no_declaration(text, problem):
    with pytest.raises(readers.DeclarationError, match=problem):
        readers.parse_declaration(text, needs_playlist=True)


def test_lines_are_numbered_over_byte_ranges(spark, tmp_path):
    rnd = random.Random(1)
    wanted = []
    (tmp_path / "log").mkdir()
    for name in ("a", "b", "c"):
        lines = ["x" * rnd.choice([0, 1, 7, 40, 3000 if name == "b" else 9]) + str(k) for k in range(400)]
        (tmp_path / "log" / name).write_text("\n".join(lines) + ("" if name == "c" else "\n"))
        wanted += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "100000000"):  # many ranges of a file, or whole files
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.numbered_lines(spark, str(tmp_path / "log")).orderBy("number").collect()
            assert [(r["number"], r["value"]) for r in got] == list(enumerate(wanted))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_log_of_several_ranges_gives_the_same_rows(spark, tmp_path):
    lines = []
    for commit in range(60):
        lines += [str(1_700_000_000 + commit), "diff --git a/x b/x", *(f'{"-" if k % 3 == 0 else "+"}  (s: "{A[:-3]}{(commit * 7 + k) % 900 + 100}", q: 3),' for k in range(5))]
    (tmp_path / "log").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("700", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append(sorted(map(tuple, readers.git_log_file(spark, str(tmp_path / "log")).collect())))
            assert O.first_added(readers.git_log_file(spark, str(tmp_path / "log"))).count() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] and len(seen[0]) == 300 and seen[0][0][:3] == (0, 1_700_000_000, 2)


def test_files_are_dealt_to_outputs_near_the_aim():
    rnd = random.Random(2)
    lengths = [(f"f{k}", int(1000 * rnd.random() ** 4) + 1) for k in range(3000)] + [("huge", 10_400), ("big", 1_300)]
    plan, held = sinks.dealt(lengths, 1000), {}
    assert sorted(p for p, *_ in plan) == sorted(p for p, _ in lengths)
    for (path, first, n), size in zip(plan, [dict(lengths)[p] for p, *_ in plan], strict=True):
        for output in range(first, first + n):
            held[output] = held.get(output, 0) + size / n
    assert sorted(held) == list(range(len(held))) and max(held.values()) <= 2000 and sorted(held.values())[1] >= 500


def test_skewed_buckets_become_even_files(spark, tmp_path):
    place, target, aim = f"file://{tmp_path}/b", f"file://{tmp_path}/one table", 40_000
    rows = spark.range(60_000).select((F.when(F.col("id") < 50_000, 0).otherwise(F.col("id") % 8)).cast("int").alias("bucket"), "id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    rows.repartition(5).write.option("compression", "zstd").partitionBy("bucket").parquet(place)
    spark.range(50).select(F.lit(3).alias("bucket"), "id", F.lit("x").alias("v")).repartition(40).write.option("compression", "zstd").mode("append").partitionBy("bucket").parquet(place)
    was = [size for _, size in sinks.files(spark, place)]
    assert max(was) > 5 * aim and min(was) < aim / 20
    got = sinks.compact(spark, place, target, aim)
    assert got.count() == 60_050 and got.columns == ["id", "v"] and got.agg(F.sum("id"), F.count_distinct("v")).first()[:] == (sum(range(60_000)) + sum(range(50)), 60_001)
    sizes = sorted(size for _, size in sinks.files(spark, target))
    assert sizes[-1] <= 2 * aim and sizes[1] >= aim / 2 and len(sizes) < len(was)


def test_a_table_is_replaced_by_renames(spark, tmp_path):
    place = f"file://{tmp_path}/t"
    sinks.write_atomic(spark.range(3), place)
    with pytest.raises(Exception, match="boom"):
        sinks.write_atomic(spark.range(3).select(F.raise_error(F.lit("boom")).alias("x")), place)
    assert spark.read.parquet(place).count() == 3  # a failed write leaves the old table
    sinks.write_atomic(spark.range(5), place)
    assert spark.read.parquet(place).count() == 5 and [p.name for p in tmp_path.iterdir() if "old" in p.name] == []
