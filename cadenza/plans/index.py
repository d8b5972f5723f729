"""Build, absorb and open the index.

Every stage of a build lies in a folder of its own, named by what it was made from (:mod:`cadenza.plans.manifest`), so a
changed input never meets stale stages and an unchanged one is not built again.  Readers follow the index's newest
pointer, which is written last and says where each part lies.

Plays and user statistics lie in buckets of users.  A fold writes only the buckets that its dumps touch, new keys and
new credits as parts of their own, and points to everything else where it is.  Folders that neither the newest pointer
nor the one before it names are deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import schema as S
from cadenza.functions import values as V
from cadenza.operators import library as L
from cadenza.operators.ordered import running_max
from cadenza.plans.manifest import Manifest, fingerprint, parts_of, stamp
from cadenza.sources import sinks

BUCKETED = ("user_plays", "user_stat")
PARTS = ("recording", "recording_artist", "user_plays", "user_stat", "recording_listener", "artist_link")


def build(spark: SparkSession, listens: DataFrame, declared: DataFrame, links: DataFrame, index: str, dump: str, known_own: int | None = None) -> dict:
    """Build what is not built yet and publish it; returns the meta record, in which ``rebuilt`` names the stages that were made.

    Another own user keeps the scan of the library, its keys and its credits; other links keep all but the links.
    """
    made = Manifest(spark, index)
    heard, linked = fingerprint(listens), fingerprint(links)
    recording = made.stage("recording", [heard], lambda: L.surrogate_keys(listens.where("recording_mbid IS NOT NULL").select(F.col("recording_mbid").alias("mbid"))))
    library = made.stage("library", [heard, "recording"], lambda: L.count_numbered(listens, recording))
    named = sinks.staged(recording.join(declared.select("mbid").distinct(), "mbid").select("recording_id", "mbid"), "declared")
    own = L.own_user(library.join(named, "recording_id"), declared, known_own).first()  # one row
    if own is None or own["own"] is None:
        raise ValueError("the declaration singles out no user")
    own_row = spark.createDataFrame([(own["own"],)], "own long")
    members = made.stage("pool", ["library", f"own {own['own']}"], lambda: L.pool(library, own_row))
    plays = made.stage("user_plays", ["library", "pool"], lambda: L.of_members(library, members), sinks.write_buckets, S.USER_PLAYS)
    made.stage("user_stat", ["user_plays"], lambda: L.user_stat(plays), sinks.write_buckets, S.USER_STAT)
    made.stage("recording_listener", ["user_plays"], lambda: L.recording_listener(plays))
    made.stage("recording_artist", [heard, "recording"], lambda: L.artist_bridge(listens, recording))
    made.stage("artist_link", [linked], lambda: L.symmetric_links(links))
    version = made.version(PARTS)
    buckets = {part: {b: made.folder(part) for b in sinks.buckets(spark, made.folder(part))} for part in BUCKETED}
    parts = {part: [made.folder(part)] for part in PARTS if part not in BUCKETED}
    stages = [made.folder(stage) for stage in ("library", "pool")]
    meta = {"dump": dump, "own": own["own"], "reached": None, "gap": [], "absorbed": 0, "buckets": buckets, "parts": parts, "stages": stages, "held": []}
    return _publish(spark, index, version, meta) | {"rebuilt": [stage for stage, fresh in made.built.items() if fresh]}


def derive(spark: SparkSession, version: str) -> None:
    """The parts that follow from the fact table; also what an older version lacks."""
    plays = spark.read.parquet(f"{version}/user_plays").drop("bucket")
    if not sinks.done(spark, f"{version}/user_stat"):
        sinks.write_buckets(L.user_stat(plays), f"{version}/user_stat")
    sinks.step(lambda: L.recording_listener(plays), spark, f"{version}/recording_listener")


def _part(spark: SparkSession, meta: dict, part: str, only: Sequence[str] | None = None) -> DataFrame:
    """A part of the published version; of a bucketed one all buckets, or those of ``only``."""
    if part not in BUCKETED:
        return spark.read.parquet(*meta["parts"][part])
    found = [f"{folder}/bucket={b}" for b, folder in sorted(meta["buckets"][part].items()) if only is None or b in only]
    schema = S.USER_PLAYS if part == "user_plays" else S.USER_STAT
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def _folders(index: str, meta: dict) -> set[str]:
    """The folders of the index that a meta record names."""
    places = [meta["version"], *meta["stages"], *(f for of in meta["parts"].values() for f in of), *(f for of in meta["buckets"].values() for f in of.values())]
    return {f"{index}/{place.removeprefix(index).lstrip('/').split('/')[0]}" for place in places}


def _publish(spark: SparkSession, index: str, version: str, meta: dict) -> dict:
    before = sinks.meta(spark, index)
    meta = meta | {"version": version}
    mine = _folders(index, meta)
    held = sorted({*meta["held"], *(before["held"] if before else ()), *mine})
    meta |= {p: _part(spark, meta, p).count() for p in ("recording", "user_plays", "user_stat")}
    named = mine | (_folders(index, before) if before else set())
    meta["held"] = sorted(named & set(held))
    sinks.publish(spark, index, version, meta)
    sinks.delete(spark, *(folder for folder in held if folder not in named))
    return meta


def completeness(spark: SparkSession, version: str) -> str:
    places = parts_of(spark, version)
    have = {p for p in PARTS if (sinks.complete(spark, places[p]) if p in places else sinks.done(spark, f"{version}/{p}"))}
    if set(PARTS) <= have:
        return "built"
    if {"recording", "recording_artist", "user_plays"} <= have:
        return "predates_stat" if "user_stat" not in have else "predates_listener" if "recording_listener" not in have else "indexed"
    return "scanned" if have else "absent"


def open_index(spark: SparkSession, index: str) -> dict[str, DataFrame]:
    """The parts of the published version, registered as views."""
    meta = sinks.meta(spark, index)
    if meta is None:
        raise FileNotFoundError(index)
    parts = {p: _part(spark, meta, p) for p in PARTS}
    for name, part in parts.items():
        part.createOrReplaceTempView(name)
    return parts


def fold_plan(dumps: DataFrame, covered: int) -> DataFrame:
    """What becomes of each dump (name, start, end as 14-digit numbers), in order of its end.

    A dump that starts before what is covered is skipped whole, so that nothing counts twice; it is a gap if
    it reaches further.  One that starts later leaves a gap and is folded.  What is covered before a dump is
    the largest end above it, since every dump that reaches further moves it.
    """
    rows = running_max(dumps, F.col("end"), "end", "start", "name", name="reached", own=False)
    rows = rows.withColumn("covered", F.greatest(F.coalesce("reached", F.lit(covered)), F.lit(covered)))
    folded = F.col("start") >= F.col("covered")
    gap_to = F.when(folded & (F.col("start") > F.col("covered")), F.col("start")).when(~folded & (F.col("end") > F.col("covered")), F.col("end"))
    return rows.select("name", "start", "end", "covered", folded.alias("folded"), F.when(gap_to.isNotNull(), F.col("covered")).alias("gap_from"), gap_to.alias("gap_to"))


def absorb(spark: SparkSession, delta: DataFrame, index: str, name: str, start: int, end: int) -> dict:
    """Fold one dated dump into a new version of the index, exactly once."""
    dated = delta.withColumns({"start": F.lit(start).cast("long"), "end": F.lit(end).cast("long")})
    return absorb_all(spark, dated, index, [(name, start, end)])


def absorb_all(spark: SparkSession, delta: DataFrame, index: str, dumps: Sequence[tuple[str, int, int]]) -> dict:
    """Fold dated dumps (name, start, end), whose rows bear start and end, in one pass, each exactly once.

    Counts are sums that saturate, so folding together gives what folding one after another does.
    """
    meta = sinks.meta(spark, index)
    old = open_index(spark, index)
    covered = meta["reached"] or int(meta["dump"])
    told = fold_plan(spark.createDataFrame(list(dumps), "name string, start long, end long"), covered).orderBy("end", "start", "name").collect()  # one row a dump
    meta |= {"gap": meta["gap"] + [[r["gap_from"], r["gap_to"]] for r in told if r["gap_to"]], "reached": max([covered, *(r["end"] for r in told)])}
    folded = [r for r in told if r["folded"]]
    if not folded:
        sinks.publish(spark, index, meta["version"], meta)
        return meta
    version = f"{index}/{stamp(meta['version'], *((r['name'], r['end']) for r in folded))}"
    windows = F.broadcast(spark.createDataFrame([(r["start"], r["end"]) for r in folded], "start long, end long").distinct())
    rows = delta.join(windows, ["start", "end"], "left_semi").drop("start", "end")
    plays = sinks.staged(L.count_plays(rows), "delta")
    # Ids that were given never move, so a retried fold must find the same table of new ids.
    taken = old["recording"].agg(F.coalesce(F.max("recording_id"), F.lit(0))).first()[0]
    sinks.step(lambda: L.extend_keys(old["recording"], plays.select("mbid").distinct()).where(F.col("recording_id") > taken), spark, f"{version}/recording")
    parts = {part: list(of) for part, of in meta["parts"].items()}
    parts["recording"].append(f"{version}/recording")
    recording = spark.read.parquet(*parts["recording"])
    frozen = sinks.staged(L.user_plays(plays, recording, old["user_stat"]), "frozen")  # the pool admits nobody new
    touched = [str(r["bucket"]) for r in frozen.select(V.bucket(F.col("user_id")).alias("bucket")).distinct().collect()]  # at most as many as there are buckets
    was = _part(spark, meta, "user_plays", touched)
    buckets = {part: dict(of) for part, of in meta["buckets"].items()}
    if touched:
        if not sinks.done(spark, f"{version}/user_plays"):
            sinks.write_buckets(L.merge_plays(was, frozen), f"{version}/user_plays")
        now = spark.read.parquet(f"{version}/user_plays").drop("bucket")
        if not sinks.done(spark, f"{version}/user_stat"):
            sinks.write_buckets(L.user_stat(now), f"{version}/user_stat")
        for part in BUCKETED:
            buckets[part] |= {b: f"{version}/{part}" for b in touched}
        # Listeners are sums over users: what the touched buckets said goes, what they say now comes.
        less = L.recording_listener(was).select("recording_id", (-F.col("listener")).alias("listener"), (-F.col("plays")).alias("plays"))
        sums = old["recording_listener"].unionByName(less).unionByName(L.recording_listener(now)).groupBy("recording_id").agg(F.sum("listener").alias("listener"), F.sum("plays").alias("plays"))
        sinks.step(lambda: sums.where("listener > 0"), spark, f"{version}/recording_listener")
        parts["recording_listener"] = [f"{version}/recording_listener"]
    credits = L.artist_bridge(rows, recording)
    known = old["recording_artist"].join(credits.select("recording_id").distinct(), "recording_id", "left_semi")
    sinks.step(lambda: credits.join(known, ["recording_id", "artist_mbid"], "left_anti"), spark, f"{version}/recording_artist")
    parts["recording_artist"].append(f"{version}/recording_artist")
    return _publish(spark, index, version, meta | {"absorbed": meta["absorbed"] + len(folded), "buckets": buckets, "parts": parts})


def pending(dumps: DataFrame, covered: int) -> DataFrame:
    """Dumps (name, size) that reach further than what is covered, oldest first."""
    known = dumps.withColumn("p", V.published(F.col("name"))).where("p IS NOT NULL")
    return known.select("name", "size", F.col("p.number").alias("number"), F.col("p.reach").alias("reach")).where(F.col("reach") > covered).orderBy("reach", "name")
