"""Outliers, feeds, sync, payloads, files, incremental folding and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.functions import values as V
from cadenza.operators import feeds as Fd
from cadenza.operators import library as L
from cadenza.operators import outliers as O
from cadenza.operators import sync as Sy
from cadenza.operators.ordered import median, numbered
from cadenza.plans import index as Ix
from cadenza.plans import recommend as R
from cadenza.queries.standin import Inputs, mbid, sql_mbid
from cadenza.sources import readers as Rd

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs.of(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r(name: str):
    return F.round(F.col(name), 6).alias(name)


# Outliers: a declared entry is a part, its listens the quantity sold, its age from the part's key.
_DECLARED = "declared AS (SELECT CAST(p_partkey AS VARCHAR) AS mbid, CAST(p_partkey % 5 AS INTEGER) AS q FROM part WHERE p_partkey % 3 <> 0), counts AS (SELECT CAST(l_partkey AS VARCHAR) AS mbid, CAST(sum(l_quantity) AS BIGINT) AS heard FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1), age AS (SELECT CAST(p_partkey AS VARCHAR) AS mbid, p_partkey * 7 % 200 AS days FROM part WHERE p_partkey % 10 <> 0)"
_OBSERVED = f"{_DECLARED}, observed AS (SELECT mbid, q, coalesce(heard, 0) AS heard, coalesce(days, 0) AS days, coalesce(heard, 0) / greatest(coalesce(days, 0), 1) AS rate FROM declared LEFT JOIN counts USING (mbid) LEFT JOIN age USING (mbid))"
_NEAREST = f"{_OBSERVED}, med AS (SELECT q AS m_q, median(rate) AS median FROM observed WHERE days >= 21 GROUP BY 1), near AS (SELECT * FROM (SELECT o.*, m_q AS observed, row_number() OVER (PARTITION BY mbid ORDER BY abs(rate - median), m_q) AS rn FROM observed o, med WHERE days >= 21) WHERE rn = 1)"


def _observed(i: Inputs) -> DataFrame:
    part, key = i.table("part"), F.col("p_partkey")
    declared = part.where("p_partkey % 3 <> 0").select(key.cast("string").alias("mbid"), (key % 5).cast("int").alias("q"))
    counts = i.table("lineitem").where("l_partkey % 4 <> 0").groupBy(F.col("l_partkey").cast("string").alias("mbid")).agg(F.sum("l_quantity").cast("long").alias("heard"))
    age = part.where("p_partkey % 10 <> 0").select(key.cast("string").alias("mbid"), (key * 7 % 200).alias("days"))
    return O.observations(declared, counts, age)


query("join_left_lookup", f"WITH {_OBSERVED} SELECT mbid, q, heard, days, round(rate, 6) AS rate FROM observed")(lambda i: _observed(i).select("mbid", "q", "heard", "days", r("rate")))
query("filter_min_age", f"WITH {_OBSERVED} SELECT mbid, days FROM observed WHERE days >= 21")(lambda i: O.old_enough(_observed(i)).select("mbid", "days"))
query("agg_median_rust", f"WITH {_OBSERVED} SELECT round(coalesce(median(rate), 0), 6) AS median FROM observed WHERE days >= 21")(lambda i: median(O.old_enough(_observed(i)), "rate").select(F.round(F.coalesce("median", F.lit(0.0)), 6).alias("median")))
query("agg_median_per_q", f"WITH {_OBSERVED} SELECT q, round(median(rate), 6) AS median FROM observed WHERE days >= 21 GROUP BY 1")(lambda i: O.median_per_q(_observed(i)).select("q", r("median")))
query("agg_count_per_q", f"WITH {_DECLARED} SELECT q, count(*) AS n, CAST(100 * count(*) // (SELECT count(*) FROM declared) AS BIGINT) AS percent FROM declared GROUP BY 1")(
    lambda i: (lambda d: d.groupBy("q").agg(F.count("*").alias("n")).crossJoin(F.broadcast(d.agg(F.count("*").alias("all")))).select("q", "n", F.call_function("div", F.col("n") * 100, F.col("all")).alias("percent")))(_observed(i))
)
query("agg_matched", f"WITH {_OBSERVED} SELECT count(*) AS matched FROM observed WHERE heard > 0")(lambda i: _observed(i).agg(F.count_if(F.col("heard") > 0).alias("matched")))
query("argmin_nearest", f"WITH {_NEAREST} SELECT mbid, q, observed FROM near")(lambda i: (lambda o: O.nearest_q(o, O.median_per_q(o)).select("mbid", "q", "observed"))(_observed(i)))
query("filter_outlier", f"WITH {_NEAREST} SELECT mbid, q, observed, heard, days FROM near WHERE observed <> q")(lambda i: O.outliers(_observed(i)).select("mbid", "q", "observed", "heard", "days"))
query("sort_outlier", f"WITH {_NEAREST} SELECT mbid, CAST(row_number() OVER (ORDER BY abs(q - observed) DESC, rate DESC, mbid) AS BIGINT) AS rank FROM near WHERE observed <> q")(
    lambda i: O.ranked_outliers(_observed(i)).select("mbid", "rank")
)

# Songs: declared ones have clean titles, listened ones variants of them.
_VARIANT = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' (Live)') WHEN 2 THEN upper(p_name) WHEN 3 THEN concat(p_name, ' Remix') WHEN 4 THEN concat('unheard ', p_partkey) ELSE p_name END"
_ARTIST = "CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN '' WHEN 2 THEN concat(p_brand, ' & Guest') ELSE 'Somebody' END"


def _songs(i: Inputs) -> tuple[DataFrame, DataFrame]:
    part = i.table("part")
    declared = part.select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("mbid"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    listened = part.select(F.expr("CASE WHEN p_partkey < 10 THEN concat('d', p_partkey) ELSE concat('l', p_partkey) END").alias("mbid"), F.expr(_VARIANT).alias("title"), F.expr(_ARTIST).alias("artist"), F.col("p_partkey").alias("heard"))
    return declared, listened


_SONGS = f"""WITH d AS (SELECT concat('d', p_partkey) AS entry, p_name AS t, lower(replace(p_brand, '#', '')) AS a FROM part),
l AS (SELECT CASE WHEN p_partkey < 10 THEN concat('d', p_partkey) ELSE concat('l', p_partkey) END AS mbid, p_partkey AS heard,
  CASE WHEN p_partkey % 6 = 4 THEN concat('unheard ', p_partkey) WHEN p_partkey % 6 = 1 THEN concat(p_name, ' live') WHEN p_partkey % 6 = 3 THEN concat(p_name, ' remix') ELSE p_name END AS t,
  CASE WHEN p_partkey % 6 = 4 THEN concat('unheard ', p_partkey) ELSE p_name END AS s,
  CASE p_partkey % 4 WHEN 1 THEN [] WHEN 3 THEN ['somebody'] WHEN 2 THEN [lower(replace(p_brand, '#', '')), 'guest'] ELSE [lower(replace(p_brand, '#', ''))] END AS a FROM part),
same AS (SELECT mbid AS entry, mbid, 0 AS step FROM l WHERE mbid IN (SELECT entry FROM d)),
pair AS (SELECT entry, mbid, CASE WHEN d.t = l.t THEN 2 ELSE 1 END AS level, len(l.a) = 0 OR list_contains(l.a, d.a) AS agree FROM l JOIN d ON d.t = l.s WHERE mbid NOT IN (SELECT entry FROM d)),
matched AS (SELECT entry, mbid, 1 AS step FROM (SELECT *, max(level) OVER (PARTITION BY mbid) AS best FROM pair WHERE agree) WHERE level = best),
exact AS (SELECT min(entry) AS entry, mbid FROM pair WHERE level = 2 AND mbid NOT IN (SELECT mbid FROM matched) GROUP BY mbid HAVING count(*) = 1),
bare AS (SELECT min(entry) AS entry, mbid FROM pair WHERE mbid NOT IN (SELECT mbid FROM matched) AND mbid NOT IN (SELECT mbid FROM exact) GROUP BY mbid HAVING count(*) = 1),
assigned AS (SELECT * FROM same UNION ALL SELECT * FROM matched UNION ALL SELECT *, 2 FROM exact UNION ALL SELECT *, 2 FROM bare)"""
query("join_fuzzy_song", f"{_SONGS} SELECT entry, mbid, CAST(step AS INTEGER) AS step FROM assigned")(lambda i: O.assign(*_songs(i)))
query("song_exact_match", f"{_SONGS} SELECT entry, mbid FROM pair WHERE level = 2 AND agree")(lambda i: O.title_matches(*_songs(i), O.EXACT))
query("song_stripped_match", f"{_SONGS} SELECT entry, mbid FROM pair WHERE level = 1 AND agree")(lambda i: O.title_matches(*_songs(i), O.STRIPPED))
query("song_unique_title", f"{_SONGS} SELECT entry, mbid FROM assigned WHERE step = 2")(lambda i: O.assign(*_songs(i)).where("step = 2").select("entry", "mbid"))
query("set_undeclared", f"{_SONGS} SELECT mbid, heard FROM l WHERE mbid NOT IN (SELECT mbid FROM assigned)")(lambda i: (lambda d, l: O.undeclared(l, O.assigned_once(d, l)).select("mbid", "heard"))(*_songs(i)))  # noqa: E741
query("sort_undeclared", f"{_SONGS} SELECT mbid, CAST(row_number() OVER (ORDER BY heard DESC, mbid) AS BIGINT) AS rank FROM l WHERE mbid NOT IN (SELECT mbid FROM assigned)")(
    lambda i: (lambda d, l: numbered(O.undeclared(l, O.assigned_once(d, l)).select("mbid", "heard"), F.desc("heard"), "mbid", name="rank", first=1).select("mbid", "rank"))(*_songs(i))  # noqa: E741
)

# History: orders are commits, their lines added or removed entries.
_LOG = """log AS (SELECT o_orderkey AS commit, l_linenumber * 100000 + l_partkey AS line, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS sign,
  {mbid} AS mbid, concat('q', l_suppkey % 3) AS rest FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
#: The log read line by line: what is open to be replaced is a queue.
_WALK = """placed AS (SELECT *, row_number() OVER (PARTITION BY commit, rest ORDER BY line, sign DESC, mbid) AS k FROM log),
walk AS (SELECT commit, rest, k, line, mbid, sign, CASE WHEN sign = '-' THEN [mbid] ELSE CAST([] AS VARCHAR[]) END AS open, CAST(NULL AS VARCHAR) AS taken FROM placed WHERE k = 1
  UNION ALL SELECT p.commit, p.rest, p.k, p.line, p.mbid, p.sign, CASE WHEN p.sign = '-' THEN list_append(open, p.mbid) WHEN len(open) > 0 THEN open[2:] ELSE open END,
    CASE WHEN p.sign = '+' AND len(open) > 0 THEN open[1] END FROM walk JOIN placed p ON p.commit = walk.commit AND p.rest = walk.rest AND p.k = walk.k + 1)"""


#: Lines of the log that a task sorts at once.
LOG_LINES = 1 << 19


def _log(i: Inputs, entry) -> DataFrame:
    """Every order as a commit; ``entry`` is what its lines add or remove."""
    lines, orders = i.table("lineitem"), i.table("orders").select("o_orderkey")
    # A commit's lines are sorted where they are joined: more lines are more tasks, not larger ones.
    if (tasks := -(-lines.count() // LOG_LINES)) > int(i.spark.conf.get("spark.sql.shuffle.partitions")):
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("commit"), (F.col("o_orderkey") * 1000).alias("at"), (F.col("l_linenumber").cast("long") * 100000 + F.col("l_partkey")).alias("line"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("sign"),
        entry.alias("mbid"), F.concat(F.lit("q"), (F.col("l_suppkey") % 3).cast("string")).alias("rest"),
    )


query("join_replace_pairing", f"""WITH RECURSIVE {_LOG.format(mbid="concat('m', l_partkey % 50)")}, {_WALK}
SELECT commit, mbid, taken AS inherited FROM walk WHERE taken <> mbid""")(lambda i: O.replacement_pairs(_log(i, F.concat(F.lit("m"), (F.col("l_partkey") % 50).cast("string")))))
query("win_first_added", f"""WITH RECURSIVE {_LOG.format(mbid="concat('e', l_partkey)")}, {_WALK},
first AS (SELECT * FROM (SELECT commit, line, mbid, taken, row_number() OVER (PARTITION BY mbid ORDER BY commit, line) AS r FROM walk WHERE sign = '+') WHERE r = 1),
link AS (SELECT f.mbid, f.taken AS parent FROM first f JOIN first p ON p.mbid = f.taken WHERE p.commit < f.commit OR p.commit = f.commit AND p.line < f.line),
chain AS (SELECT mbid, mbid AS root FROM first UNION ALL SELECT chain.mbid, parent FROM chain JOIN link ON link.mbid = chain.root)
SELECT chain.mbid, min(first.commit) * 1000 AS at FROM chain JOIN first ON first.mbid = chain.root GROUP BY 1""")(lambda i: O.first_added(_log(i, F.concat(F.lit("e"), F.col("l_partkey").cast("string")))))
query("agg_daily_last", "SELECT CAST(day AS VARCHAR) AS day, event_id, CAST(n AS BIGINT) AS n FROM (SELECT ts::DATE AS day, event_id, CASE WHEN event_id % 2 = 0 THEN event_id // 5 ELSE event_id END AS n, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")(lambda i: _daily(i))


def _daily(i: Inputs) -> DataFrame:
    """The last commit of each day and its entries; the old format has five lines per entry."""
    n = F.when(F.col("event_id") % 2 == 0, F.call_function("div", F.col("event_id"), F.lit(5))).otherwise(F.col("event_id"))
    last = i.table("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.max_by(F.struct("event_id", n.cast("long").alias("n")), F.struct("ts", "event_id")).alias("e"))
    return last.select("day", "e.event_id", "e.n")


query("agg_average_per_day", "SELECT round(max(event_id) / greatest(date_diff('day', min(ts::DATE), max(ts::DATE)), 1), 6) AS per_day FROM events")(
    lambda i: i.table("events").agg(F.round(F.max("event_id") / F.greatest(F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))), F.lit(1)), 6).alias("per_day"))
)

# Feeds: event types are feeds.
_FEED = "feed AS (SELECT event_type AS feed, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS position, concat('m', user_id) AS mbid, CASE WHEN event_id % 5 = 0 THEN ts END AS heard_at FROM events)"
_INDEXED = f"{_FEED}, indexed AS (SELECT *, row_number() OVER (ORDER BY position, feed) AS idx FROM feed)"


def _feeds(i: Inputs) -> DataFrame:
    rows = i.table("events").select(F.col("event_type").alias("feed"), "ts", "event_id", F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("mbid"), F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("latest_listened_at"))
    return Fd.positions(rows, "ts", "event_id", by="feed").drop("ts", "event_id")


def _skip(i: Inputs) -> DataFrame:
    ids = i.table("events").select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("mbid"), "user_id")
    return ids.where("user_id % 4 = 0").select("mbid").unionByName(ids.where("user_id % 6 = 0").select("mbid")).distinct()


query("win_position", f"WITH {_FEED} SELECT feed, CAST(position AS BIGINT) AS position, mbid FROM feed")(lambda i: _feeds(i).select("feed", "position", "mbid"))
query("feed_round_robin", f"WITH {_INDEXED} SELECT CAST(idx AS BIGINT) AS idx, feed, mbid FROM indexed")(lambda i: Fd.interleave(_feeds(i)).select(F.col("index").alias("idx"), "feed", "mbid"))
query("filter_unlistened", f"WITH {_FEED} SELECT feed, mbid, count(*) AS n FROM feed WHERE heard_at IS NULL GROUP BY 1, 2")(lambda i: Fd.unlistened(_feeds(i)).groupBy("feed", "mbid").agg(F.count("*").alias("n")))
query("filter_skip", f"WITH {_FEED} SELECT feed, mbid, count(*) AS n FROM feed WHERE mbid NOT IN (SELECT concat('m', user_id) FROM events WHERE user_id % 4 = 0 OR user_id % 6 = 0) GROUP BY 1, 2")(
    lambda i: _feeds(i).join(_skip(i), "mbid", "left_anti").groupBy("feed", "mbid").agg(F.count("*").alias("n"))
)
query("set_declared_declined", "SELECT DISTINCT concat('m', user_id) AS mbid FROM events WHERE user_id % 4 = 0 OR user_id % 6 = 0")(lambda i: _skip(i))
query("feed_dedupe", f"WITH {_INDEXED} SELECT mbid, CAST(min(idx) AS BIGINT) AS idx FROM indexed WHERE heard_at IS NULL AND mbid NOT IN (SELECT concat('m', user_id) FROM events WHERE user_id % 4 = 0 OR user_id % 6 = 0) GROUP BY 1")(
    lambda i: Fd.merged(_feeds(i), _skip(i), only_unlistened=True).select("mbid", F.col("index").alias("idx"))
)
query("island_round_robin", "WITH c AS (SELECT o_orderpriority AS island, o_orderkey AS position, concat('m', o_orderkey) AS mbid FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY position) AS turn FROM c WHERE position % 7 <> 0) SELECT CAST(row_number() OVER (ORDER BY turn, island) AS BIGINT) AS idx, island, mbid FROM t")(
    lambda i: _turns(i)
)


def _turns(i: Inputs) -> DataFrame:
    rows = i.table("orders").select(F.col("o_orderpriority").alias("island"), F.col("o_orderkey").alias("position"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("mbid"))
    rank = rows.select("island").distinct().withColumn("rank", F.row_number().over(Window.orderBy("island")))
    return Fd.island_turns(rows, rank, rows.where("position % 7 = 0")).select(F.col("index").alias("idx"), "island", "mbid")


_POPULAR = "pop AS (SELECT CAST(p_partkey AS VARCHAR) AS mbid, p_size % 10 * 100 AS heard, CASE WHEN p_partkey % 3 <> 0 THEN DATE '2000-01-01' + CAST(p_partkey % 700 AS INTEGER) END AS released FROM part)"


def _popular(i: Inputs) -> DataFrame:
    key = F.col("p_partkey")
    return i.table("part").select(key.cast("string").alias("mbid"), (F.col("p_size") % 10 * 100).alias("heard"), F.when(key % 3 != 0, F.date_add(F.lit("2000-01-01").cast("date"), (key % 700).cast("int"))).alias("released"))


query("sort_popularity", f"WITH {_POPULAR} SELECT mbid, CAST(row_number() OVER (ORDER BY heard DESC, mbid) - 1 AS BIGINT) AS position FROM pop WHERE heard > 0")(lambda i: Fd.by_popularity(_popular(i)).select("mbid", "position"))
query("sort_newest", f"WITH {_POPULAR} SELECT mbid, CAST(row_number() OVER (ORDER BY released DESC NULLS LAST, heard DESC, mbid) - 1 AS BIGINT) AS position FROM pop")(lambda i: Fd.by_newest(_popular(i)).select("mbid", "position"))
query("topk_weeks", f"WITH {_POPULAR} SELECT mbid, CAST(released AS VARCHAR) AS week FROM pop WHERE released IS NOT NULL ORDER BY released DESC, mbid LIMIT 2")(
    lambda i: Fd.weeks(_popular(i).where("released IS NOT NULL").withColumnRenamed("released", "week")).select("mbid", F.col("week").cast("string").alias("week"))
)

# Sync: desired is what parts say, actual what suppliers and brands suggest.
_SYNC = "declared AS (SELECT CAST(p_partkey AS VARCHAR) AS mbid, CAST(p_partkey % 5 AS INTEGER) AS q, [p_brand, p_type] AS playlist FROM part), tier AS (SELECT mbid, CAST(unnest(range(q + 1)) AS INTEGER) AS tier FROM declared), was AS (SELECT DISTINCT CAST(p_size % 5 AS INTEGER) AS tier, CAST(p_partkey AS VARCHAR) AS mbid FROM part), lists AS (SELECT mbid, unnest(playlist) AS playlist FROM declared)"
_DIFF = f"{_SYNC}, diff AS (SELECT tier, 'add' AS action, mbid FROM tier ANTI JOIN was USING (tier, mbid) UNION ALL SELECT tier, 'remove', mbid FROM was ANTI JOIN tier USING (tier, mbid))"


def _entries(i: Inputs) -> DataFrame:
    return i.table("part").select(F.col("p_partkey").cast("string").alias("mbid"), (F.col("p_partkey") % 5).cast("int").alias("q"), F.array("p_brand", "p_type").alias("playlist"))


def _was(i: Inputs) -> DataFrame:
    return i.table("part").select((F.col("p_size") % 5).cast("int").alias("tier"), F.col("p_partkey").cast("string").alias("mbid"))


def _tier_diff(i: Inputs) -> DataFrame:
    return Sy.diff(Sy.tiers(_entries(i)), _was(i), "tier")


query("set_tier_expand", f"WITH {_SYNC} SELECT tier, mbid FROM tier")(lambda i: Sy.tiers(_entries(i)))
query("set_playlist_expand", f"WITH {_SYNC} SELECT DISTINCT playlist, mbid FROM lists")(lambda i: Sy.playlists(_entries(i)))
query("set_diff_add", f"WITH {_DIFF} SELECT tier, mbid FROM diff WHERE action = 'add'")(lambda i: Sy.to_add(Sy.tiers(_entries(i)), _was(i), "tier"))
query("set_diff_remove", f"WITH {_DIFF} SELECT tier, mbid FROM diff WHERE action = 'remove'")(lambda i: Sy.to_remove(Sy.tiers(_entries(i)), _was(i), "tier"))
query("sort_sync", f"WITH {_DIFF} SELECT tier, action, mbid, CAST(row_number() OVER (PARTITION BY tier, action ORDER BY mbid) AS INTEGER) AS position FROM diff")(
    lambda i: numbered(_tier_diff(i), "mbid", name="position", first=1, by=("tier", "action")).withColumn("position", F.col("position").cast("int"))
)
query("filter_touched_group", f"WITH {_DIFF} SELECT DISTINCT tier FROM diff")(lambda i: _tier_diff(i).select("tier").distinct())
query("report_truncate", f"""WITH {_DIFF}, listed AS (SELECT concat(tier, '/', CAST(mbid AS BIGINT) % 997) AS list, action, mbid FROM diff)
SELECT list, action, count(*) AS n, CASE WHEN count(*) <= 4 THEN string_agg(mbid, ',' ORDER BY mbid) ELSE '' END AS shown FROM listed GROUP BY 1, 2""")(
    lambda i: Sy.report(_tier_diff(i).select(F.concat(F.col("tier").cast("string"), F.lit("/"), (F.col("mbid").cast("long") % 997).cast("string")).alias("list"), "action", "mbid"), "list")
)
_RATED = "rated AS (SELECT mbid, CAST(CASE q WHEN 0 THEN 5 WHEN 1 THEN 50 WHEN 2 THEN 70 WHEN 3 THEN 90 ELSE 100 END AS BIGINT) AS value FROM declared), sent AS (SELECT CAST(p_partkey AS VARCHAR) AS mbid, 50 AS value FROM part WHERE p_partkey % 2 = 0), pending AS (SELECT rated.mbid, rated.value FROM rated LEFT JOIN sent USING (mbid) WHERE sent.value IS DISTINCT FROM rated.value)"


def _pending_ratings(i: Inputs) -> DataFrame:
    sent = i.table("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("mbid"), F.lit(50).cast("long").alias("value"))
    return Sy.rating_diff(_entries(i), sent)


query("join_rating_diff", f"WITH {_SYNC}, {_RATED} SELECT mbid, value FROM pending")(_pending_ratings)
query("sink_rating_xml", f"""WITH {_SYNC}, {_RATED}, n AS (SELECT *, row_number() OVER (ORDER BY mbid) - 1 AS k FROM pending)
SELECT CAST(k // 200 AS BIGINT) AS chunk, count(*) AS n, string_agg(concat('<recording id="', mbid, '"><user-rating>', value, '</user-rating></recording>'), '' ORDER BY k) AS body FROM n GROUP BY 1""")(lambda i: Sy.rating_chunks(_pending_ratings(i)))
query("filter_existing_file", "SELECT CAST(p_partkey AS VARCHAR) AS mbid FROM part SEMI JOIN (SELECT s_suppkey AS p_partkey FROM supplier) USING (p_partkey)")(
    lambda i: _entries(i).join(i.table("supplier").select(F.col("s_suppkey").cast("string").alias("mbid")), "mbid", "left_semi").select("mbid")
)
query("first_success_by_priority", "SELECT mbid, url FROM (SELECT CAST(l_partkey AS VARCHAR) AS mbid, concat('u', l_suppkey) AS url, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, concat('u', l_suppkey)) AS r FROM lineitem WHERE l_returnflag = 'A') WHERE r = 1")(
    lambda i: Sy.first_success(i.table("lineitem").select(F.col("l_partkey").cast("string").alias("mbid"), F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("url"), F.col("l_linenumber").alias("priority"), (F.col("l_returnflag") == "A").alias("ok")))
)
query("chase_redirect", "WITH RECURSIVE hop AS (SELECT p_partkey AS id, p_partkey AS live FROM part UNION ALL SELECT id, live // 2 FROM hop WHERE live >= 2 AND live % 3 <> 0) SELECT id, min(live) AS live FROM hop GROUP BY 1")(
    lambda i: Sy.chase(i.table("part").select(F.col("p_partkey").alias("id")), i.table("part").where("p_partkey >= 2 AND p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.call_function("div", F.col("p_partkey"), F.lit(2).cast("long")).alias("target")))
)
query("sink_declaration_edit", "SELECT p_partkey, concat('  (s: \"', p_name, '\", q: ', CASE WHEN p_name = 'red widget' THEN 4 ELSE p_partkey % 5 END, '), // ', p_brand) AS line FROM part")(
    lambda i: _edit(i.table("part").select("p_partkey", F.expr("concat('  (s: \"', p_name, '\", q: ', p_partkey % 5, '), // ', p_brand)").alias("line")))
)


def _edit(lines: DataFrame) -> DataFrame:
    from cadenza.sources.sinks import edit_q

    return edit_q(lines, "red widget", 4, "line")


query("sink_declaration_append", "SELECT CAST(p_partkey AS VARCHAR) AS s FROM part UNION SELECT CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE concat('new ', s_suppkey) END FROM supplier")(lambda i: _append(i))


def _append(i: Inputs) -> DataFrame:
    from cadenza.sources.sinks import append_entry

    entry = i.table("supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise(F.concat(F.lit("new "), F.col("s_suppkey").cast("string"))).alias("s"))
    return append_entry(i.table("part").select(F.col("p_partkey").cast("string").alias("s")), entry)


# Payloads: rows become JSON pages and are read back.
def _uuid_or(text: str, rest: int):
    return F.when(F.col("p_partkey") % rest != 0, mbid(F.col("p_partkey"))).otherwise(F.lit(text))


def _paged(i: Inputs, item, by: int = 50) -> DataFrame:
    rows = i.table("part").select(F.call_function("div", F.col("p_partkey"), F.lit(by).cast("long")).alias("page"), "p_partkey", item.alias("item"))
    return rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda x: x["item"]).alias("items"))


_ID = sql_mbid("p_partkey")
query("scan_json_stats", f"SELECT mbid, CAST(max_by(p_size, p_partkey) AS BIGINT) AS count, max_by(p_name, p_partkey) AS track, max_by(p_brand, p_partkey) AS artist FROM (SELECT *, {sql_mbid('p_partkey % 120')} AS mbid FROM part WHERE p_partkey % 13 <> 0) GROUP BY 1")(
    lambda i: Rd.json_stats(
        _paged(i, F.struct(F.when(F.col("p_partkey") % 13 != 0, mbid(F.col("p_partkey") % 120)).alias("recording_mbid"), F.col("p_size").cast("long").alias("listen_count"), F.col("p_name").alias("track_name"), F.col("p_brand").alias("artist_name"))).select("page", F.to_json(F.struct(F.struct(F.col("items").alias("recordings")).alias("payload"))).alias("body"))
    )
)
def _counted(i: Inputs, pages: DataFrame) -> DataFrame:
    """``pages`` with ``total``, the number of places in the feed: no page lies behind it."""
    return pages.crossJoin(F.broadcast(i.table("part").agg((F.max("p_partkey") + 1).cast("int").alias("total"))))


def _cf(i: Inputs) -> DataFrame:
    item = F.struct(_uuid_or("?", 17).alias("recording_mbid"), F.col("p_retailprice").alias("score"), F.when(F.col("p_partkey") % 2 == 0, "2024-01-01T00:00:00Z").alias("latest_listened_at"))
    payload = F.struct((F.col("page") * 50).cast("int").alias("offset"), F.lit(50).alias("count"), F.col("total").alias("total_mbid_count"), F.col("items").alias("mbids"))
    pages = _counted(i, _paged(i, item)).select(F.to_json(F.struct(payload.alias("payload"))).alias("body"))
    return Rd.json_cf(pages).select("position", "mbid", "score", F.coalesce("latest_listened_at", F.lit("")).alias("latest"))


def _catalogue(i: Inputs) -> DataFrame:
    item = F.struct(_uuid_or("x", 17).alias("id"), F.expr("CASE p_partkey % 3 WHEN 0 THEN '1999' WHEN 1 THEN '2001-05' ELSE 'soon' END").alias("first_release_date"))
    page = F.struct((F.col("page") * 50).cast("int").alias("offset"), F.col("total").alias("count"), F.col("items").alias("recordings"))
    return Rd.json_catalogue(_counted(i, _paged(i, item)).select(F.to_json(page).alias("body"))).select("mbid", F.col("released").cast("string").alias("released"))


query("scan_json_cf", f"SELECT CAST(p_partkey AS INTEGER) AS position, {_ID} AS mbid, p_retailprice AS score, CASE WHEN p_partkey % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE '' END AS latest FROM part WHERE p_partkey % 17 <> 0")(_cf)
query("scan_json_popularity", f"SELECT {_ID} AS mbid, CAST(CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END AS BIGINT) AS heard, CAST(CASE WHEN p_partkey % 4 <> 0 THEN p_size ELSE 0 END AS BIGINT) AS user FROM part")(
    lambda i: Rd.json_popularity(_paged(i, F.struct(mbid(F.col("p_partkey")).alias("recording_mbid"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("long")).alias("total_listen_count"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("long")).alias("total_user_count"))).select(F.to_json("items").alias("body")))
)
_PREFIX = "https://x.org/recording/"


def _playlists(i: Inputs) -> DataFrame:
    track = F.struct(F.array(F.concat(F.lit(_PREFIX), _uuid_or("none", 9))).alias("identifier"))
    made = _paged(i, track, 20).select(
        F.to_json(
            F.struct(F.array(F.struct(F.struct(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("page").cast("int")), "yyyy-MM-dd").alias("date"), F.concat(F.lit("list"), F.col("page").cast("string")).alias("identifier"), F.when(F.col("page") % 2 == 0, "weekly-exploration").otherwise("daily-jams").alias("source_patch"), F.col("items").alias("track")).alias("playlist"))).alias("playlists"))
        ).alias("body")
    )
    return Rd.json_playlists(made)


query("scan_jspf", f"SELECT concat('list', p_partkey // 20) AS identifier, CAST(p_partkey % 20 AS INTEGER) AS position, {_ID} AS mbid FROM part WHERE p_partkey % 9 <> 0")(lambda i: Rd.tracks(_playlists(i), _PREFIX))
query("filter_source_patch", "SELECT DISTINCT concat('list', p_partkey // 20) AS identifier, CAST(DATE '2024-01-01' + CAST(p_partkey // 20 AS INTEGER) AS VARCHAR) AS week FROM part WHERE p_partkey // 20 % 2 = 0")(
    lambda i: _playlists(i).where(F.col("source_patch") == "weekly-exploration").select("identifier", F.col("week").cast("string").alias("week"))
)
query("scan_catalogue", f"SELECT {_ID} AS mbid, CASE p_partkey % 3 WHEN 0 THEN '1999-01-01' WHEN 1 THEN '2001-05-01' END AS released FROM part WHERE p_partkey % 17 <> 0")(_catalogue)
query("scan_m3u", f"SELECT DISTINCT {_ID} AS mbid FROM part WHERE p_partkey % 6 > 1")(
    lambda i: Rd.m3u(i.table("part").select(F.when(F.col("p_partkey") % 6 == 0, "#EXTM3U").when(F.col("p_partkey") % 6 == 1, "../music/song.opus").otherwise(F.concat(F.lit("../music/"), mbid(F.col("p_partkey")), F.lit(".opus"))).alias("value")))
)
query("scan_rsync_listing", "SELECT concat('dump ', p_partkey, '.tar') AS name, CAST(p_partkey * 1001 AS BIGINT) AS size FROM part WHERE p_partkey % 5 <> 0")(
    lambda i: Rd.rsync_listing(i.table("part").select(F.when(F.col("p_partkey") % 5 == 0, "drwxr-xr-x   4,096 2024/01/01 00:00:00 .").otherwise(F.concat(F.lit("-rw-r--r-- "), F.format_number(F.col("p_partkey") * 1001, 0), F.lit(" 2024/01/01 10:00:00 dump "), F.col("p_partkey").cast("string"), F.lit(".tar"))).alias("value")))
)
query("agg_argmax_size", "SELECT p_brand, max_by(p_name, [p_size, p_partkey]) AS name FROM part GROUP BY 1")(lambda i: i.table("part").groupBy("p_brand").agg(F.max_by("p_name", F.struct("p_size", "p_partkey")).alias("name")))
query("agg_argmax_number", "SELECT concat('dump-', max(event_id), '-full') AS name FROM events")(
    lambda i: i.table("events").select(F.concat(F.lit("dump-"), F.col("event_id").cast("string"), F.lit("-full")).alias("name")).agg(F.max(F.struct(F.regexp_extract("name", "-([0-9]+)-", 1).cast("long").alias("n"), "name"))["name"].alias("name"))
)
query("agg_sum_bytes", "SELECT CAST(sum(o_orderkey) AS BIGINT) AS bytes FROM orders")(lambda i: i.table("orders").agg(F.sum("o_orderkey").alias("bytes")))
query("agg_max_bytes", "SELECT max(o_orderkey) * 4 AS bytes FROM orders")(lambda i: i.table("orders").agg((F.max("o_orderkey") * 4).alias("bytes")))
query("count_rows", "SELECT count(*) AS n FROM lineitem")(lambda i: i.table("lineitem").agg(F.count("*").alias("n")))
query("pred_source_routing", "SELECT * FROM (VALUES ('all', 'collaborative_filtering', false), ('all', 'island', true), ('all', 'play_count', false), ('all', 'weekly_exploration', false), ('collaborative_filtering', 'collaborative_filtering', false), ('island', 'island', true), ('play_count', 'play_count', false), ('weekly_exploration', 'weekly_exploration', false)) t(source, feed, needs_index)")(
    lambda i: i.spark.createDataFrame(R.ROUTES, "source string, feed string, needs_index boolean")
)
query("scan_shards", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")(lambda i: Rd.shards(i.spark, i.sf_dir + "/orders.parquet").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")))
query("scan_shard_list", "SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS keys FROM lineitem")(lambda i: Rd.shard_list(i.spark, [f"{i.sf_dir}/lineitem.parquet"]).agg(F.count("*").alias("n"), F.sum("l_partkey").alias("keys")))
query("scan_glob", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part")(lambda i: i.spark.read.parquet(f"{i.sf_dir}/par*.parquet").agg(F.count("*").alias("n"), F.sum("p_size").alias("size")))

# Folding: orders are dated dumps.
_DUMPS = "dumps AS (SELECT CAST(o_orderkey AS VARCHAR) AS name, o_orderkey * 10 + o_custkey % 17 - 8 AS start, o_orderkey * 10 + 10 AS \"end\" FROM orders), told AS (SELECT *, greatest(coalesce(max(\"end\") OVER (ORDER BY \"end\", start, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 35), 35) AS covered FROM dumps)"


def _folds(i: Inputs) -> DataFrame:
    rows = i.table("orders").select(F.col("o_orderkey").cast("string").alias("name"), (F.col("o_orderkey") * 10 + F.col("o_custkey") % 17 - 8).alias("start"), (F.col("o_orderkey") * 10 + 10).alias("end"))
    return Ix.fold_plan(rows, 35)


query("stream_fold_once", f"WITH {_DUMPS} SELECT name, covered, start >= covered AS folded FROM told")(lambda i: _folds(i).select("name", "covered", "folded"))
query("stream_late_data", f"WITH {_DUMPS} SELECT name, start, covered FROM told WHERE start < covered")(lambda i: _folds(i).where("NOT folded").select("name", "start", "covered"))
query("stream_gap_repair", f"WITH {_DUMPS} SELECT name, covered AS gap_from, CASE WHEN start > covered THEN start ELSE \"end\" END AS gap_to FROM told WHERE start > covered OR (start < covered AND \"end\" > covered)")(
    lambda i: _folds(i).where("gap_to IS NOT NULL").select("name", "gap_from", "gap_to")
)
query("stream_windows", "SELECT CAST(ts::DATE AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda i: _windowed(i))


def _windowed(i: Inputs) -> DataFrame:
    """A stream over the table's files (a pattern, since a stream takes no single file), with its counts in the state store."""
    import uuid

    from cadenza.sources.sinks import run_dir
    from cadenza.streaming.absorb import count_windows

    place = f"{run_dir(i.spark)}/windows-{uuid.uuid4().hex}"
    count_windows(i.spark, f"{i.sf_dir}/event[s].parquet", f"{place}/counts", f"{place}/checkpoint").awaitTermination()
    return i.spark.read.parquet(f"{place}/counts").select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n")
