"""Builds notice what has changed, and only that."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.plans import index as Ix
from cadenza.plans.manifest import fingerprint
from cadenza.sources import sinks
from tests.test_engine import UUID, listens, made_index

ROWS = [(1, m, 5) for m in range(10)] + [(u, m, 4) for u in range(2, 7) for m in range(6)] + [(u, m, 3) for u in range(2, 7) for m in range(20, 45)]


def build(spark, folder, rows=ROWS, links=(("artist1", "artist2"),), declared=range(10)):
    entries = spark.createDataFrame([(UUID(m), m % 5) for m in declared], "mbid string, q int")
    return Ix.build(spark, listens(spark, rows), entries, spark.createDataFrame(list(links), "artist_mbid string, related_mbid string"), folder, "20240101000000")


def test_only_what_depends_on_a_change_is_built_again(spark, tmp_path):
    folder = str(tmp_path / "index")
    first = build(spark, folder)
    assert set(first["rebuilt"]) == {"library", "recording", "pool", *Ix.PARTS} and first["recording"] == 35
    assert build(spark, folder)["rebuilt"] == []
    assert build(spark, folder, links=[("artist1", "artist3")])["rebuilt"] == ["artist_link"]
    # Another own user keeps the library, its keys and its credits.
    other = build(spark, folder, [*ROWS, *((8, m, 5) for m in range(60, 80))])
    assert other["recording"] == 55 and "library" in other["rebuilt"]
    own = build(spark, folder, [*ROWS, *((8, m, 5) for m in range(60, 80))], declared=range(60, 80))
    assert own["own"] == 8 and sorted(own["rebuilt"]) == ["pool", "recording_listener", "user_plays", "user_stat"]
    assert Ix.completeness(spark, own["version"]) == "built"


def test_other_rows_under_the_same_name_are_noticed(spark, tmp_path):
    folder = str(tmp_path / "index")
    build(spark, folder)
    meta = build(spark, folder, [*ROWS, *((1, m, 5) for m in range(100, 105))])
    assert meta["recording"] == 40 and Ix.open_index(spark, folder)["recording"].count() == 40


def test_fingerprints_of_files_and_of_rows(spark, tmp_path):
    place = f"file://{tmp_path}/t"
    spark.range(10).write.parquet(place)
    read = lambda: spark.read.parquet(place)
    assert fingerprint(read()) == fingerprint(read())
    assert fingerprint(read()) != fingerprint(read().where("id > 3")) != fingerprint(read().where("id > 4"))
    was = fingerprint(read())
    spark.range(3).write.mode("append").parquet(place)
    assert fingerprint(read()) != was
    assert fingerprint(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")) == fingerprint(spark.createDataFrame([(2, None), (1, "a")], "k int, v string"))
    assert fingerprint(spark.createDataFrame([(1, "a")], "k int, v string")) != fingerprint(spark.createDataFrame([(1, None)], "k int, v string"))


def test_a_fold_points_to_what_it_leaves(spark, tmp_path):
    folder = str(tmp_path / "index")
    made_index(spark, folder)
    before = sinks.meta(spark, folder)
    Ix.absorb(spark, listens(spark, [(2, 0, 1), (2, 99, 2)]), folder, "d1", 20240101000000, 20240102000000)
    after, parts = sinks.meta(spark, folder), Ix.open_index(spark, folder)
    assert after["parts"]["artist_link"] == before["parts"]["artist_link"] and after["parts"]["recording"][:1] == before["parts"]["recording"]
    assert spark.read.parquet(after["parts"]["recording"][1]).count() == 1 and parts["recording"].agg(F.countDistinct("recording_id")).first()[0] == 36
    assert spark.read.parquet(after["parts"]["recording_artist"][1]).count() == 1
    # A new build over the fold's index starts from its own stages, and what no pointer names is deleted.
    again = build(spark, folder)
    assert again["rebuilt"] == [] and again["absorbed"] == 0
    build(spark, folder, ROWS[:-1]), build(spark, folder, ROWS[:-2])
    assert not sinks.exists(spark, after["version"])
