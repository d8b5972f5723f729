"""What is written and read back: every query writes to this application's part of the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.plans import index as Ix
from cadenza.queries.standin import Inputs, mbid, sql_mbid, with_inputs
from cadenza.sources import readers as Rd
from cadenza.sources import sinks as Sk
from cadenza.streaming import absorb

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs.of(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


def _place(i: Inputs, name: str) -> str:
    return f"{Sk.run_dir(i.spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_bucket", with_inputs("SELECT user_id, recording_id, plays FROM user_plays WHERE user_id % 8 = 3"))
def _(i: Inputs) -> DataFrame:
    """One bucket of the fact table: the other folders are not read."""
    place = _place(i, "buckets")
    Sk.write_buckets(i.user_plays, place)
    return Rd.bucket(i.spark, place, 3).drop("bucket")


@query("compact_buckets", with_inputs("SELECT user_id, round(center, 6) AS center, round(low, 6) AS low, round(high, 6) AS high, recording FROM user_stat"))
def _(i: Inputs) -> DataFrame:
    """Statistics that were written by bucket, as one table."""
    place = _place(i, "stat")
    Sk.write_buckets(i.user_stat, place)
    return Sk.compact(i.spark, place, f"{place}-compacted").select("user_id", *[F.round(c, 6).alias(c) for c in ("center", "low", "high")], "recording")


@query("backfill_part", with_inputs("SELECT recording_id, listener, plays FROM recording_listener"))
def _(i: Inputs) -> DataFrame:
    """An index that has plays but no statistics gets them; a second call finds them complete."""
    version = _place(i, "version")
    Sk.write_buckets(i.user_plays, f"{version}/user_plays")
    for _ in range(2):
        Ix.derive(i.spark, version)
    return i.spark.read.parquet(f"{version}/recording_listener")


@query("index_completeness", "SELECT * FROM (VALUES (0, 'absent'), (1, 'scanned'), (2, 'predates_stat'), (3, 'predates_listener'), (4, 'indexed'), (5, 'built')) t(step, state)")
def _(i: Inputs) -> DataFrame:
    """The state of a version as one part after another is written."""
    version, told = _place(i, "version"), []
    steps = [(), ("recording",), ("recording_artist", "user_plays"), ("user_stat",), ("recording_listener",), ("artist_link",)]
    for step, parts in enumerate(steps):
        for part in parts:
            Sk.write_atomic(getattr(i, part), f"{version}/{part}")
        told.append((step, Ix.completeness(i.spark, version)))
    return i.spark.createDataFrame(told, "step int, state string")


@query("invalidate_on_stamp", with_inputs(""", half AS (SELECT * FROM listens WHERE part % 2 = 0), link AS (SELECT * FROM artist_link)
SELECT step, part, rebuilt, CAST(n AS BIGINT) AS n FROM (
  SELECT step, 'recording' AS part, step IN (0, 2) AS rebuilt, CASE WHEN step < 2 THEN (SELECT count(DISTINCT recording_mbid) FROM half) ELSE (SELECT count(DISTINCT recording_mbid) FROM listens) END AS n FROM range(4) t(step)
  UNION ALL SELECT step, 'recording_artist', step IN (0, 2), CASE WHEN step < 2 THEN (SELECT count(*) FROM (SELECT DISTINCT recording_mbid, unnest(credits) FROM half)) ELSE (SELECT count(*) FROM (SELECT DISTINCT recording_mbid, unnest(credits) FROM listens)) END FROM range(4) t(step)
  UNION ALL SELECT step, 'artist_link', step IN (0, 3), CASE WHEN step < 3 THEN (SELECT count(*) FROM link) ELSE (SELECT count(*) FROM link WHERE artist_mbid LIKE '%ECONOMY%') END FROM range(4) t(step))"""))
def _(i: Inputs) -> DataFrame:
    """Four builds under one dump's name: the rows of even parts, the same again, all rows, and other links.

    Each says which parts were built again, and how many rows they have.
    """
    index, told = _place(i, "index"), []
    listens = Sk.staged(i.dump, "listens")
    links = Sk.staged(i.artist_link, "links")
    some, fewer = listens.where("part % 2 = 0"), links.where("artist_mbid LIKE '%ECONOMY%' AND related_mbid LIKE '%ECONOMY%'")
    for step, (heard, linked) in enumerate(((some, links), (some, links), (listens, links), (listens, fewer))):
        meta = Ix.build(i.spark, heard.drop("part"), i.declared, linked, index, "20240101000000", known_own=1)
        parts = Ix.open_index(i.spark, index)
        told += [(step, part, part in meta["rebuilt"], parts[part].count()) for part in ("recording", "recording_artist", "artist_link")]
    return i.spark.createDataFrame(told, "step int, part string, rebuilt boolean, n long")


@query("scan_tsv", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 <> 0 THEN concat('\"', c_name) END AS gid FROM customer")
def _(i: Inputs) -> DataFrame:
    place = _place(i, "tsv")
    gid = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit('"'), "c_name")).otherwise("\\N")
    i.table("customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), gid).alias("value")).write.text(place)
    return Rd.tsv(i.spark, place, ["id", "gid"])


def _declared_text(i: Inputs) -> str:
    """What customer 1 declares, as a file of entries over several lines."""
    place = _place(i, "declaration")
    names = F.concat_ws(", ", F.transform("playlist", lambda p: F.concat(F.lit('"'), p, F.lit('"'))))
    entry = F.concat(F.lit('  ( // "http://x"\n    s: "'), "mbid", F.lit('",\n    q: '), F.col("q").cast("string"), F.lit(", playlist: ["), names, F.lit("],),"))
    text = i.declared.agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("t")).select(F.concat(F.lit("[ /* mine */\n"), "t", F.lit("\n]")).alias("value"))
    text.write.text(place)
    return place


@query("scan_declaration", with_inputs("SELECT mbid AS s, q, array_to_string(playlist, ',') AS playlist FROM declared"))
def _(i: Inputs) -> DataFrame:
    return Rd.declaration(i.spark, _declared_text(i)).select("s", "q", F.array_join("playlist", ",").alias("playlist"))


@query("load_declared", with_inputs("SELECT mbid AS s, q FROM declared"))
def _(i: Inputs) -> DataFrame:
    """Entries in memory; a declaration is small."""
    rows = i.declared.select("mbid", "q", "playlist").collect()
    return Rd.declared(i.spark, [(r["mbid"], r["q"], r["playlist"]) for r in rows]).select("s", "q")


_LOG = f"""log AS (SELECT o_orderkey * 1000 AS k, NULL AS sign, NULL AS mbid, 1600000000 + o_orderkey AS at FROM orders
  UNION ALL SELECT o_orderkey * 1000 + l_linenumber, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END, {sql_mbid('l_partkey')}, NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT o_orderkey * 1000 + 999, NULL, NULL, NULL FROM orders),
line AS (SELECT *, row_number() OVER (ORDER BY k, sign, mbid) - 1 AS number FROM log)"""


@query("scan_git_log", f"WITH {_LOG} SELECT h.number AS commit, h.at, l.number AS line, l.sign, l.mbid FROM line l JOIN line h ON h.at IS NOT NULL AND h.k = l.k // 1000 * 1000 WHERE l.sign IS NOT NULL")
def _(i: Inputs) -> DataFrame:
    """A written log: each order is a commit, its time on a line of its own, then its lines.

    It is written in ranges of orders; what is read back are files of lines, which the reader numbers.
    """
    orders, place = i.table("orders").select("o_orderkey"), _place(i, "log")
    lines = i.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Keys are dealt by ranges; what they say is several times as long and is written where they arrive.
    row = lambda rows, number, sign, key: rows.select(number.alias("number"), sign.alias("sign"), key.cast("long").alias("key"))
    heads = row(orders, F.col("o_orderkey") * 1000, F.lit(""), F.col("o_orderkey") + 1_600_000_000)
    entries = row(lines, F.col("o_orderkey") * 1000 + F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), F.col("l_partkey"))
    noise = row(orders, F.col("o_orderkey") * 1000 + 999, F.lit("+++ b/list"), F.lit(None))
    entry = F.concat("sign", F.lit('  (s: "'), mbid(F.col("key")), F.lit('", q: 3),'))
    value = F.when(F.col("sign") == "", F.col("key").cast("string")).when(F.col("key").isNull(), F.col("sign")).otherwise(entry)
    text = heads.unionByName(entries).unionByName(noise).repartitionByRange("number").select("number", value.alias("value"))
    text.sortWithinPartitions("number", "value").select("value").write.text(place)
    return Rd.git_log_file(i.spark, place).select("commit", "at", "line", "sign", "mbid")


@query("scan_dir_ext", "SELECT count(*) AS files FROM (SELECT DISTINCT c_nationkey FROM customer)")
def _(i: Inputs) -> DataFrame:
    """The files of a folder that have an ending, without reading them: one per nation here, and the writer's marks left out."""
    place = _place(i, "listing")
    i.table("customer").select("c_nationkey", F.col("c_name").alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(place)
    found = i.spark.read.option("recursiveFileLookup", "true").format("binaryFile").option("pathGlobFilter", "*.txt").load(place)
    return found.select(F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).alias("nation")).distinct().agg(F.count("*").alias("files"))


@query("sink_parquet_atomic", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS latest FROM orders GROUP BY 1")
def _(i: Inputs) -> DataFrame:
    """A table that is written twice, the second time in place of the first."""
    place = _place(i, "atomic")
    orders = i.table("orders")
    Sk.write_atomic(orders.select("o_custkey"), place)
    Sk.write_atomic(orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("latest")), place)
    return i.spark.read.parquet(place)


@query("sink_done_check", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(i: Inputs) -> DataFrame:
    """A stage that is complete is not run again: the second call would fail."""
    place = _place(i, "step")
    for make in (lambda: i.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), lambda: 1 // 0):
        table = Sk.step(make, i.spark, place)
    return table


@query("sink_publish", "SELECT 'v3' AS version, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines")
def _(i: Inputs) -> DataFrame:
    """The newest of three pointers."""
    index = _place(i, "published")
    counts = {"orders": i.table("orders").count(), "lines": i.table("lineitem").count()}
    for version in ("v1", "v2", "v3"):
        Sk.publish(i.spark, index, version, counts if version == "v3" else {})
    meta = Sk.meta(i.spark, index)
    return i.spark.createDataFrame([(meta["version"], meta["orders"], meta["lines"])], "version string, orders long, lines long")


@query("sink_jsonl_log", "SELECT event_id, event_type, user_id FROM events")
def _(i: Inputs) -> DataFrame:
    """A log that is appended to twice."""
    place = _place(i, "log")
    rows = i.table("events").select("event_id", "event_type", "user_id")
    for half in (0, 1):
        Sk.append_log(rows.where(F.col("event_id") % 2 == half), place)
    return i.spark.read.schema(rows.schema).json(place)


@query("sink_declined", f"SELECT DISTINCT {sql_mbid('p_partkey')} AS mbid FROM part WHERE p_partkey % 3 <> 0")
def _(i: Inputs) -> DataFrame:
    """Ids of a list that has other lines too and says some twice."""
    place = _place(i, "declined")
    ids = i.table("part").select(F.when(F.col("p_partkey") % 3 != 0, mbid(F.col("p_partkey"))).otherwise(F.concat(F.lit("no id "), "p_name")).alias("mbid"))
    for _ in range(2):
        Sk.append_declined(ids, place)
    return Sk.read_declined(i.spark, place)


@query("sink_playlist", with_inputs("SELECT concat(mbid, '.opus') AS value FROM declared WHERE list_contains(playlist, 'even')"))
def _(i: Inputs) -> DataFrame:
    place = _place(i, "playlist")
    Sk.write_playlist(i.spark, i.declared.where(F.array_contains("playlist", "even")).select("mbid"), place)
    return i.spark.read.text(place)


@query("sink_cache_json", "SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS plays, true AS damaged_is_absent FROM lineitem GROUP BY 1")
def _(i: Inputs) -> DataFrame:
    """A cache that is read back, beside one whose write was broken off."""
    place, damaged = _place(i, "cache"), _place(i, "damaged")
    Sk.write_atomic(i.table("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("plays")), place)
    Sk.write_text(i.spark, f"{damaged}/part-0.parquet", "no parquet")
    absent = Sk.read_cache(i.spark, damaged) is None
    return Sk.read_cache(i.spark, place).withColumn("damaged_is_absent", F.lit(absent))


@query("conn_archive", "SELECT n_name AS name, sha256(n_name) AS sha256 FROM nation")
def _(i: Inputs) -> DataFrame:
    """Digests of files, as they are compared with a list of digests."""
    place = _place(i, "archives")
    for r in i.table("nation").select("n_nationkey", "n_name").collect():  # 25 rows
        Sk.write_text(i.spark, f"{place}/{r['n_nationkey']}", r["n_name"])
    names = i.table("nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    return Rd.digest(i.spark, place).withColumn("key", F.element_at(F.split("path", "/"), -1)).join(names, "key").select("name", "sha256")


@query("stream_resume", "SELECT CAST(ts::DATE AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(i: Inputs) -> DataFrame:
    """A stream over files that is stopped and started again: each file counts once."""
    inbox, out, checkpoint = (_place(i, n) for n in ("inbox", "counts", "checkpoint"))
    events = i.table("events").select("ts", "event_type", "event_id")
    for part in (0, 1, None):
        if part is not None:
            events.where(F.col("event_id") % 2 == part).drop("event_id").write.mode("append").parquet(inbox)
        absorb.count_files(i.spark, inbox, out, checkpoint).awaitTermination()
    return absorb.counted(i.spark, out).select(F.col("day").cast("string").alias("day"), "event_type", "n")
