"""Behaviour of the engine on small frames."""

from __future__ import annotations

from itertools import pairwise
from math import log

import pytest
from pyspark.sql import functions as F

from cadenza.functions import attraction as A
from cadenza.functions import text as X
from cadenza.operators import islands as I
from cadenza.operators import library as L
from cadenza.operators import outliers as O
from cadenza.plans import index as Ix
from cadenza.plans import recommend as R
from cadenza.sources import readers, sinks

UUID = "00000000-0000-4000-8000-{:012d}".format


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Attraction.


@pytest.mark.parametrize(("center", "low", "high"), [(log(10), 0.0, log(100)), (log(5), 0.0, log(2000)), (log(11), log(11), log(100)), (0.0, 0.0, log(30))])
def test_attraction_rises_with_plays_and_is_bounded(spark, center, low, high):
    rows = spark.range(1, 41).select(A.value(F.col("id"), F.lit(center), F.lit(low), F.lit(high)).alias("v")).collect()
    values = [r["v"] for r in rows]
    assert all(a <= b + 1e-12 for a, b in pairwise(values))
    assert all(25 <= v <= 100 for v in values)


def test_flat_libraries_are_neutral(spark):
    assert one(spark, A.value(F.lit(7), F.lit(log(7)), F.lit(log(7)), F.lit(log(7)))) == pytest.approx(50)


def test_adoption_needs_twelve_plays_at_most_and_a_trial_repels(spark):
    args = F.lit(log(200)), F.lit(0.0), F.lit(log(2000))
    assert one(spark, A.weight(F.lit(12), *args)) >= 0
    assert one(spark, A.weight(F.lit(1), *args)) < 0


def test_sql_functions_equal_the_columns(spark):
    A.register(spark)
    rows = spark.sql("SELECT id AS plays, 1.5D AS c, 0.2D AS l, 4.0D AS h FROM range(1, 60)")
    both = rows.select(F.expr("attraction_weight(plays, c, l, h)").alias("a"), A.weight(F.col("plays"), F.col("c"), F.col("l"), F.col("h")).alias("b")).collect()
    assert all(r["a"] == pytest.approx(r["b"]) for r in both)


# Library.


def test_quantiles_are_discrete_and_weighted_by_plays(spark):
    plays = spark.createDataFrame([(1, i, 1) for i in range(10)] + [(1, 100, 90)], "user_id long, recording_id long, plays int")
    row = L.user_stat(plays).first()
    assert (row["center"], row["low"], row["high"], row["recording"]) == (pytest.approx(log(90)), 0.0, pytest.approx(log(90)), 11)


def test_plays_saturate_in_counts_and_merges(spark):
    part = spark.createDataFrame([(1, 1, 65_000)], "user_id long, recording_id long, plays int")
    assert L.merge_plays(part, part).first()["plays"] == 65_535


def test_keys_are_dense_from_zero_and_extended_from_the_largest(spark):
    names = spark.createDataFrame([(f"{i % 7}{i}",) for i in range(50)], "mbid string")
    keys = L.surrogate_keys(names).orderBy("recording_id").collect()
    assert [k["recording_id"] for k in keys] == list(range(50))
    assert [k["mbid"] for k in keys] == sorted(k["mbid"] for k in keys)
    held = L.surrogate_keys(names.limit(10).cache())
    grown = {r["mbid"]: r["recording_id"] for r in L.extend_keys(held, names).collect()}
    assert sorted(grown.values()) == list(range(50))
    assert all(grown[r["mbid"]] == r["recording_id"] for r in held.collect())
    empty = spark.createDataFrame([], "recording_id long, mbid string")
    assert L.extend_keys(empty, names).agg(F.min("recording_id")).first()[0] == 1


def test_own_user_needs_coverage_and_a_lead(spark):
    declared = spark.createDataFrame([(str(i),) for i in range(10)], "mbid string")
    of = lambda users: spark.createDataFrame([(u, str(i), 1) for u, n in users.items() for i in range(n)], "user_id long, mbid string, plays int")
    assert L.own_user(of({1: 8, 2: 5}), declared).first()["own"] == 1
    assert L.own_user(of({1: 8, 2: 7}), declared).first()["own"] is None
    assert L.own_user(of({1: 8, 2: 7}), declared, known=9).first()["own"] == 9
    assert L.own_user(of({1: 4}), declared).first()["own"] is None


# Islands.


def similarity(spark, edges):
    return spark.createDataFrame([(a, b, 1, w) for a, b, w in edges], "a string, b string, shared long, cosine double")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "mbid string")


TRIANGLES = [("a", "b", 0.5), ("b", "c", 0.5), ("a", "c", 0.5), ("d", "e", 0.5), ("e", "f", 0.5), ("d", "f", 0.5)]


def grouped(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["island"], set()).add(r["mbid"])
    return sorted(map(sorted, out.values()))


def test_two_triangles_are_two_islands_even_with_a_bridge(spark):
    assert grouped(I.communities(similarity(spark, [*TRIANGLES, ("c", "d", 0.2)]), nodes(spark, "abcdef"))) == [list("abc"), list("def")]


def test_a_clique_is_one_island_and_granularity_splits(spark):
    clique = [(a, b, 0.5) for a in "abcd" for b in "abcd" if a < b]
    assert grouped(I.communities(similarity(spark, clique), nodes(spark, "abcd"), granularity=1.0)) == [list("abcd")]
    with pytest.raises(ValueError):
        I.communities(similarity(spark, clique), nodes(spark, "abcd"), granularity=0)


def test_small_islands_are_absorbed_by_their_nearest(spark):
    edges = [*TRIANGLES, ("c", "g", 0.05)]
    assert grouped(I.communities(similarity(spark, edges), nodes(spark, "abcdefg"), least=3)) == [list("abcg"), list("def")]


def test_shared_dislike_pulls_nobody(spark):
    heard = spark.createDataFrame([("x", 0, 1, -0.5), ("x", 0, 2, 0.5), ("y", 4, 3, 1.0), ("y", 4, 2, 1.0), ("z", 1, 1, 1.0)], "mbid string, q int, user_id long, weight double")
    island = spark.createDataFrame([("x", 0), ("y", 0), ("z", 0)], "mbid string, island long")
    got = {r["user_id"]: r["weight"] for r in I.affinity(heard, island).collect()}
    assert got[1] == 0.0
    assert got[3] == pytest.approx(log(3 / 2))


def test_names_repeat_with_numbers(spark):
    named = spark.createDataFrame([(0, "pop"), (1, "pop"), (2, "rock"), (3, "pop")], "island long, name string")
    assert [r["name"] for r in I.distinct_names(named).orderBy("island").collect()] == ["pop", "pop 2", "rock", "pop 3"]


def test_options_are_checked():
    for wrong in ({"damp": -1}, {"granularity": 0}, {"island": "x", "seeds": ("a",)}, {"target": "t"}, {"sort": "newest"}):
        with pytest.raises(ValueError):
            R.validate("island", **wrong)
    R.validate("play_count", target="a", sort="newest", target_is_artist=True)


# Text.


@pytest.mark.parametrize(
    ("title", "expected"),
    [("Song (feat. X)", "song"), ("[MV] Song (Live)", "song"), ("Song (a (b))", "song"), ("Song - Remix", "song"), ("(Song)", ""), ("Song (", "song"), ("Live", ""), ("曲 リミックス", "曲"), (None, None)],
)
def test_strip_version(spark, title, expected):
    assert spark.createDataFrame([(title,)], "t string").select(X.strip_version(F.col("t")).alias("x")).first()["x"] == expected


def test_artists_are_compatible_across_scripts_only_with_exact_titles(spark):
    of = lambda a, b, exact: one(spark, X.artists_compatible(X.split_artists(F.lit(a)), X.split_artists(F.lit(b)), F.lit(exact)))
    assert of("A & B", "b feat. C", False)
    assert of("", "whoever", False)
    assert of("Yoasobi", "ヨアソビ", True)
    assert not of("Yoasobi", "ヨアソビ", False)
    assert not of("Somebody", "Nobody", True)


def test_first_added_is_inherited_through_replacements(spark):
    log_rows = [(1, 100, 1, "+", "a", "x"), (2, 200, 1, "-", "a", "x"), (2, 200, 2, "+", "b", "x"), (3, 300, 1, "-", "b", "x"), (3, 300, 2, "+", "c", "x"), (3, 300, 3, "+", "d", "y")]
    log_df = spark.createDataFrame(log_rows, "commit long, at long, line long, sign string, mbid string, rest string")
    assert {r["mbid"]: r["at"] for r in O.first_added(log_df).collect()} == {"a": 100, "b": 100, "c": 100, "d": 300}


# Sources, sinks and the index.


def test_declaration_is_parsed_and_checked(spark, tmp_path):
    file = tmp_path / "list.ron"
    file.write_text(f'[\n// mine\n    (s: "{UUID(1)}", q: 3, playlist: ["a", "b"]),\n    (s: "{UUID(2)}", q: 0),\n]\n')
    rows = {r["s"]: (r["q"], r["playlist"]) for r in readers.declaration(spark, str(file)).collect()}
    assert rows == {UUID(1): (3, ["a", "b"]), UUID(2): (0, [])}
    file.write_text(f'[\n(s: "{UUID(1)}", q: 3),\n(s: "{UUID(1)}", q: 5),\n]\n')
    with pytest.raises(ValueError, match=UUID(1)):
        readers.declaration(spark, str(file))


def test_tsv_reads_nulls_and_quotes_as_they_are(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('1\t"x\n2\t\\N\n')
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "t.tsv"), ["a", "b"]).collect()] == [("1", '"x'), ("2", None)]


def test_git_log_gives_its_lines_a_commit(spark, tmp_path):
    (tmp_path / "log").write_text(f'1700000000\n+    (s: "{UUID(1)}", q: 3),\n1700086400\n-    (s: "{UUID(1)}", q: 3),\n+    (s: "{UUID(2)}", q: 3),\n')
    lines = spark.read.text(str(tmp_path / "log")).withColumn("number", F.monotonically_increasing_id())
    rows = readers.git_log(lines).orderBy("line").collect()
    assert [(r["at"], r["sign"], r["mbid"]) for r in rows] == [(1700000000, "+", UUID(1)), (1700086400, "-", UUID(1)), (1700086400, "+", UUID(2))]
    assert {r["mbid"]: r["at"] for r in O.first_added(readers.git_log(lines)).collect()} == {UUID(1): 1700000000, UUID(2): 1700000000}


def test_failed_writes_leave_no_table(spark, tmp_path):
    path = str(tmp_path / "table")
    boom = F.udf(lambda x: 1 // 0, "int")
    with pytest.raises(Exception):
        sinks.write_atomic(spark.range(3).select(boom("id").alias("x")), path)
    assert not sinks.done(spark, path)
    sinks.write_atomic(spark.range(3), path)
    assert sinks.done(spark, path)
    assert sinks.read_cache(spark, path).count() == 3
    assert sinks.read_cache(spark, f"{path}-none") is None


def test_logs_lists_and_buckets_on_disk(spark, tmp_path):
    ids = spark.createDataFrame([(UUID(2),), (UUID(1),), (UUID(2),)], "mbid string")
    log_path, declined, playlist, buckets = (str(tmp_path / n) for n in ("log", "declined", "list", "buckets"))
    for _ in range(2):
        sinks.append_log(ids.limit(1), log_path)
        sinks.append_declined(ids, declined)
    assert spark.read.json(log_path).count() == 2
    (tmp_path / "declined" / "more.txt").write_text("no id\n")
    assert {r["mbid"] for r in sinks.read_declined(spark, declined).collect()} == {UUID(1), UUID(2)}
    assert sinks.read_declined(spark, str(tmp_path / "none")).count() == 0
    sinks.write_playlist(spark, ids, playlist)
    assert [r["value"] for r in spark.read.text(playlist).collect()] == [f"{UUID(1)}.opus", f"{UUID(2)}.opus"]
    assert {r["mbid"] for r in readers.m3u(spark.read.text(playlist)).collect()} == {UUID(1), UUID(2)}
    assert readers.listing(spark, playlist, "part-*").count() >= 1
    sinks.write_playlist(spark, ids.limit(0), playlist)
    assert not sinks.exists(spark, playlist)
    sinks.write_buckets(spark.createDataFrame([(u, 1, 1) for u in range(20)], "user_id long, recording_id long, plays int"), buckets)
    assert {r["user_id"] for r in readers.bucket(spark, buckets, 3).collect()} == {3, 11, 19}
    sinks.publish(spark, str(tmp_path), "v1", {"n": 1})
    sinks.publish(spark, str(tmp_path), "v2", {"n": 2})
    assert sinks.meta(spark, str(tmp_path)) == {"n": 2, "version": "v2"}
    sinks.publish(spark, str(tmp_path), "v3", {"n": 3})
    pointers = sorted(p.name for p in tmp_path.glob("meta-*.json"))
    assert len(pointers) == 2  # the newest and the one before it
    assert readers.digest(spark, str(tmp_path / pointers[-1])).first()["sha256"]


def listens(spark, rows):
    return spark.createDataFrame([(u, UUID(m), [f"artist{m % 9}"]) for u, m, n in rows for _ in range(n)], "user_id long, recording_mbid string, artist_credit_mbids array<string>")


def made_index(spark, folder):
    rows = [(1, m, 5) for m in range(10)] + [(u, m, 4) for u in range(2, 7) for m in range(6)] + [(u, m, 3) for u in range(2, 7) for m in range(20, 45)]
    declared = spark.createDataFrame([(UUID(m), m % 5) for m in range(10)], "mbid string, q int")
    links = spark.createDataFrame([("artist1", "artist2")], "artist_mbid string, related_mbid string")
    return Ix.build(spark, listens(spark, rows), declared, links, folder, "20240101000000"), declared


def test_index_is_built_absorbed_once_and_keeps_gaps(spark, tmp_path):
    index = str(tmp_path / "index")
    meta, declared = made_index(spark, index)
    assert (meta["own"], meta["user_stat"]) == (1, 5)
    assert Ix.completeness(spark, meta["version"]) == "built"
    before = Ix.open_index(spark, index)["user_plays"].agg(F.sum("plays")).first()[0]
    # One new play of an old recording, one of a fresh one, one by an outsider.
    delta = listens(spark, [(2, 0, 1), (2, 99, 2), (77, 0, 1)])
    meta = Ix.absorb(spark, delta, index, "d1", 20240101000000, 20240102000000)
    parts = Ix.open_index(spark, index)
    assert parts["user_plays"].agg(F.sum("plays")).first()[0] == before + 3
    assert (meta["absorbed"], meta["gap"], meta["reached"]) == (1, [], 20240102000000)
    again = Ix.absorb(spark, delta, index, "d1", 20240101000000, 20240102000000)
    assert (again["absorbed"], again["gap"]) == (1, [])
    assert Ix.open_index(spark, index)["user_plays"].agg(F.sum("plays")).first()[0] == before + 3
    late = Ix.absorb(spark, delta, index, "d2", 20240103000000, 20240104000000)
    assert (late["absorbed"], late["gap"]) == (2, [[20240102000000, 20240103000000]])
    skipped = Ix.absorb(spark, delta, index, "d3", 20240103120000, 20240105000000)
    assert (skipped["absorbed"], skipped["gap"][-1], skipped["reached"]) == (2, [20240104000000, 20240105000000], 20240105000000)
    found = R.recommend(parts, declared, community=1)
    assert "score" in found.columns
    assert found.count() >= 0


def test_stream_folds_each_file_once(spark, tmp_path):
    from cadenza.streaming import absorb

    index, inbox = str(tmp_path / "index"), tmp_path / "inbox"
    made_index(spark, index)
    before = Ix.open_index(spark, index)["user_plays"].agg(F.sum("plays")).first()[0]
    day = lambda n: listens(spark, [(2, 0, n)]).withColumns({"start": F.lit(20240100000000 + n * 1000000), "end": F.lit(20240101000000 + n * 1000000)})
    for n in (1, 2):
        day(n).coalesce(1).write.mode("append").parquet(str(inbox))
    for _ in range(2):
        query = absorb.start(spark, str(inbox), index, str(tmp_path / "checkpoint"))
        query.awaitTermination(300)
    assert Ix.open_index(spark, index)["user_plays"].agg(F.sum("plays")).first()[0] == before + 3
    assert sinks.meta(spark, index)["absorbed"] == 2


def test_entry_imports_without_the_corpus_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "cadenza", tmp_path / "cadenza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ranked_per_island' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})


# Orders, chains and parsing without limits.


def test_brackets_of_any_depth_hide_their_contents(spark):
    deep = "((((((a))))))b (c (d (e (f (g) h) i) j) k) l"
    rows = spark.createDataFrame([(deep,), ("x ) y (z",), ("(" * 40 + "a" + ")" * 40 + "é!",)], "t string").select(X.normalize_title(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["bl", "xy", "é"]


def test_redirects_are_followed_to_their_end(spark):
    from cadenza.operators import sync

    hops = [(k, k + 1) for k in range(12)] + [(100, 101), (101, 102), (102, 100)]
    start, redirect = spark.createDataFrame([(0,), (5,), (100,), (77,)], "id long"), spark.createDataFrame(hops, "id long, target long")
    assert {r["id"]: r["live"] for r in sync.chase(start, redirect).collect()} == {0: 12, 5: 12, 100: 102, 77: 77}


def test_added_lines_replace_removed_ones_above_them_only(spark):
    log_rows = [(1, 10, 1, "+", "a", "x"), (1, 10, 2, "-", "b", "x"), (1, 10, 3, "-", "c", "x"), (1, 10, 4, "+", "d", "x"), (1, 10, 5, "+", "e", "y")]
    log_df = spark.createDataFrame(log_rows, "commit long, at long, line long, sign string, mbid string, rest string")
    assert [tuple(r) for r in O.replacement_pairs(log_df).collect()] == [(1, "d", "b")]


DECLARED = f"""[ // a list, over as many lines as one likes
  (playlist: ["http://x", "a \\"b\\"",], /* any order */
   q: 4,
   s: "{UUID(1).upper()}"), (s: "{UUID(2)}",
   q: 0, playlist: []),
]"""


def test_declarations_are_read_whole(spark, tmp_path):
    assert readers.parse_declaration(DECLARED) == [(UUID(1), 4, ["http://x", 'a "b"']), (UUID(2), 0, [])]
    file = tmp_path / "list"
    for text, problem in (
        (DECLARED.replace(UUID(2), "zzz"), "line 4, column 52.*zzz"),
        ("[(q: 1)]", "line 1, column 2.*missing field s"),
        (f'[(s: "{UUID(1)}" q: 1)]', "line 1, column 45"),
        (f'[(s: "{UUID(1)}", q: 1, p: 2)]', "unknown field p"),
        ("[", "line 1, column 2"),
    ):
        file.write_text(text)
        with pytest.raises(ValueError, match=problem):
            readers.declaration(spark, str(file))


def test_numbers_and_maxima_over_ranges_equal_a_plain_loop(spark):
    from cadenza.operators.ordered import numbered, running_max

    values = [(k * 37 % 101, (k * 53) % 17) for k in range(101)]
    rows = spark.createDataFrame(values, "k long, v long").repartition(7)
    got = {r["k"]: r["index"] for r in numbered(rows, F.desc("k"), first=5).collect()}
    assert got == {k: 105 - k for k in range(101)}
    by_key, upto = dict(values), {}
    for own in (True, False):
        found = {r["k"]: r["m"] for r in running_max(rows, F.col("v"), "k", name="m", own=own).collect()}
        upto = {k: max([by_key[j] for j in range(k + own)], default=None) for k in range(101)}
        assert found == upto


def test_a_fold_writes_only_touched_buckets(spark, tmp_path):
    index = str(tmp_path / "index")
    made_index(spark, index)
    before = sinks.meta(spark, index)
    was = {p: Ix.open_index(spark, index)[p].count() for p in Ix.PARTS}
    Ix.absorb(spark, listens(spark, [(2, 0, 1), (2, 99, 2)]), index, "d1", 20240101000000, 20240102000000)
    after = sinks.meta(spark, index)
    assert sinks.buckets(spark, f"{after['version']}/user_plays") == ["2"]
    for part in Ix.BUCKETED:
        moved = {b for b in after["buckets"][part] if after["buckets"][part][b] != before["buckets"][part].get(b)}
        assert moved == {"2"}
    parts = Ix.open_index(spark, index)
    assert (parts["user_stat"].count(), parts["user_plays"].count()) == (was["user_stat"], was["user_plays"] + 1)
    for mine, fresh in ((parts["recording_listener"], L.recording_listener(parts["user_plays"])), (parts["user_stat"], L.user_stat(parts["user_plays"]))):
        assert sorted(map(tuple, mine.select(*fresh.columns).collect())) == sorted(map(tuple, fresh.collect()))
    # Several dumps at once give what one after another gives, and old folders go once no pointer names them.
    both = [("d2", 20240102000000, 20240103000000), ("d3", 20240103000000, 20240104000000)]
    delta = listens(spark, [(3, 0, 1)]).withColumns({"start": F.lit(both[0][1]), "end": F.lit(both[0][2])}).unionByName(listens(spark, [(3, 1, 4), (4, 98, 1)]).withColumns({"start": F.lit(both[1][1]), "end": F.lit(both[1][2])}))
    meta = Ix.absorb_all(spark, delta, index, both)
    assert (meta["absorbed"], meta["reached"], meta["gap"]) == (3, 20240104000000, [])
    assert Ix.open_index(spark, index)["user_plays"].agg(F.sum("plays")).first()[0] == parts["user_plays"].agg(F.sum("plays")).first()[0] + 6
