"""Filters, joins, aggregates, windows, top-k and sets over the index and the recommender."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza import schema as S
from cadenza.functions import attraction as A
from cadenza.functions import values as V
from cadenza.operators import islands as I
from cadenza.operators import library as L
from cadenza.operators.ordered import median, numbered
from cadenza.operators.similarity import similar
from cadenza.queries.standin import Inputs, mbid, sql_mbid, with_inputs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, inputs: bool = True):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs.of(spark, sf_dir))
        if sql:
            ORACLES[name] = with_inputs(sql) if inputs else sql
        return f

    return add


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# Projections, filters and predicates.
query("proj_cast", "SELECT CAST(user_id AS BIGINT) AS user_id, recording_mbid AS mbid, CAST(n AS INTEGER) AS plays FROM listens")(
    lambda i: i.listens.select(F.col("user_id").cast("long").alias("user_id"), F.col("recording_mbid").alias("mbid"), F.col("n").cast("int").alias("plays"))
)
query("filter_not_null", "SELECT event_id, k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL")(
    lambda i: i.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where(F.col("k").isNotNull())
)
query("filter_list_not_null", "SELECT recording_mbid, count(*) AS n FROM listens WHERE credits IS NOT NULL GROUP BY 1")(
    lambda i: i.per_part.where(F.col("artist_credit_mbids").isNotNull()).groupBy("recording_mbid").agg(F.sum("n").alias("n"))
)
query("filter_play_floor", "SELECT user_id, mbid, plays FROM library WHERE plays >= 3 AND user_id <> 1")(lambda i: i.library.where((F.col("plays") >= S.MIN_PLAYS) & (F.col("user_id") != 1)))
query("filter_bucket", "SELECT user_id, mbid, plays FROM library WHERE user_id % 8 = 3")(lambda i: i.library.where(V.bucket(F.col("user_id")) == 3))
query("filter_backer", "SELECT recording_id, island, round(weight, 6) AS weight, backer FROM support WHERE backer >= 5 AND weight > 0")(
    lambda i: i.backing.where((F.col("backer") >= S.MIN_BACKERS) & (F.col("weight") > 0)).select("recording_id", "island", r("weight"), "backer")
)
query("proj_case_value", "SELECT mbid, q, CASE q WHEN 0 THEN 5 WHEN 1 THEN 50 WHEN 2 THEN 70 WHEN 3 THEN 90 ELSE 100 END AS value, round((CASE q WHEN 0 THEN 5 WHEN 1 THEN 50 WHEN 2 THEN 70 WHEN 3 THEN 90 ELSE 100 END - 50) / 50, 6) AS weight FROM declared")(
    lambda i: i.declared.select("mbid", "q", V.q_value(F.col("q")).alias("value"), F.round(V.q_weight(F.col("q")), 6).alias("weight"))
)
query("pred_placeholder", "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token <> '' AND token NOT LIKE '%:%' AND token NOT IN ('music', 'other', 'misc', 'unknown') GROUP BY 1", inputs=False)(
    lambda i: _placeholder(i)
)


def _placeholder(i: Inputs):
    from cadenza.functions.text import is_genre

    return i.table("part").select(F.explode(F.split("p_name", " ")).alias("token")).where(is_genre(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


# Joins.
query("join_inner_mbid_text", "SELECT recording_id, count(*) AS n, CAST(sum(len(credits)) AS BIGINT) AS credits FROM listens JOIN recording ON mbid = recording_mbid GROUP BY 1")(
    lambda i: i.per_part.join(i.recording, F.col("mbid") == F.col("recording_mbid")).groupBy("recording_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.size("artist_credit_mbids")).alias("credits"))
)
query("join_inner_mbid", "SELECT user_id, recording_id, plays FROM library JOIN recording USING (mbid)")(lambda i: i.library.join(i.recording, "mbid").select("user_id", "recording_id", "plays"))
query("join_using_stat", "SELECT user_id, recording_id, plays, round(center, 6) AS center, round(low, 6) AS low, round(high, 6) AS high, recording FROM user_plays JOIN user_stat USING (user_id)")(
    lambda i: i.drawn.select("user_id", "recording_id", "plays", r("center"), r("low"), r("high"), "recording")
)
query("join_cohort", "SELECT user_id, recording_id, plays, island FROM user_plays JOIN cohort USING (user_id)")(lambda i: i.user_plays.join(i.cohort, "user_id").select("user_id", "recording_id", "plays", "island"))
query("join_multi_dim", "SELECT b.recording_id, island, round(weight, 6) AS weight, mbid, listener, l.plays FROM support b JOIN recording USING (recording_id) JOIN recording_listener l USING (recording_id)")(
    lambda i: i.backing.join(i.recording, "recording_id").join(i.recording_listener, "recording_id").select("recording_id", "island", r("weight"), "mbid", "listener", "plays")
)
query("join_artist_fanout", "SELECT island, mbid, artist_mbid FROM candidate JOIN recording_artist USING (recording_id)")(lambda i: i.scored.join(i.recording_artist, "recording_id").select("island", "mbid", "artist_mbid"))
query("join_whole", "SELECT user_id, round(x, 6) AS x, CAST(reached AS BIGINT) AS reached, CAST(recording AS BIGINT) AS recording, CAST(heard AS BIGINT) AS heard FROM running")(
    lambda i: L.running_listens(L.occurrence(i.user_plays)).select("user_id", r("x"), "reached", "recording", "heard")
)
_ARTIST = "artist AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'gid-' || p_partkey AS gid FROM part), link AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS entity0, CAST(l_suppkey AS VARCHAR) AS entity1 FROM lineitem)"
query("join_role_twice", f"WITH {_ARTIST}, edge AS (SELECT a.gid AS x, b.gid AS y FROM link JOIN artist a ON entity0 = a.id JOIN artist b ON entity1 = b.id) SELECT x AS artist_mbid, y AS related_mbid FROM edge UNION SELECT y, x FROM edge", inputs=False)(
    lambda i: L.artist_links(
        i.table("lineitem").select(F.col("l_partkey").cast("string").alias("entity0"), F.col("l_suppkey").cast("string").alias("entity1")).distinct(),
        i.table("part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("gid-"), F.col("p_partkey").cast("string")).alias("gid")),
    )
)
query("join_cross_scalar", "SELECT user_id, round(recording / (SELECT median(recording) FROM user_stat), 6) AS share FROM user_stat")(
    lambda i: i.user_stat.crossJoin(F.broadcast(median(i.user_stat, "recording", name="usual"))).select("user_id", F.round(F.col("recording") / F.col("usual"), 6).alias("share"))
)
query("join_semi_pool", "SELECT user_id, mbid, plays FROM library SEMI JOIN pool USING (user_id)")(lambda i: i.library.join(i.pool, "user_id", "left_semi"))
query("join_semi_seed", "SELECT user_id, mbid, plays FROM library SEMI JOIN declared USING (mbid)")(lambda i: i.library.join(i.declared, "mbid", "left_semi").select("user_id", "mbid", "plays"))
query("join_semi_link", "SELECT artist_mbid, related_mbid FROM artist_link SEMI JOIN seed_artist USING (artist_mbid)")(
    lambda i: i.artist_link.join(i.recording_artist.join(i.recording.join(i.declared, "mbid", "left_semi"), "recording_id", "left_semi"), "artist_mbid", "left_semi")
)
query("join_anti_fresh", "SELECT DISTINCT mbid FROM library ANTI JOIN (SELECT mbid FROM library WHERE user_id % 3 = 0) USING (mbid)")(
    lambda i: i.library.select("mbid").distinct().join(i.library.where("user_id % 3 = 0").select("mbid").distinct(), "mbid", "left_anti")
)
query("join_not_exists", "SELECT recording_id, island FROM support JOIN recording USING (recording_id) WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.mbid = recording.mbid)")(
    lambda i: i.backing.join(i.recording, "recording_id").join(i.declared, "mbid", "left_anti").select("recording_id", "island")
)
query("join_not_exists_nested", "SELECT recording_id, island FROM support b WHERE NOT EXISTS (SELECT 1 FROM recording_artist ra SEMI JOIN known USING (artist_mbid) WHERE ra.recording_id = b.recording_id)")(
    lambda i: i.backing.join(i.recording_artist.join(i.known, "artist_mbid", "left_semi"), "recording_id", "left_anti").select("recording_id", "island")
)
_HALVES = "held AS (SELECT user_id, mbid, CAST(least(sum(n), 65535) AS INTEGER) AS plays FROM (SELECT *, recording_mbid AS mbid FROM listens) WHERE n > 20 GROUP BY 1, 2), delta AS (SELECT user_id, mbid, CAST(least(sum(n), 65535) AS INTEGER) AS plays FROM (SELECT *, recording_mbid AS mbid FROM listens) WHERE n <= 20 GROUP BY 1, 2)"


def _halves(i: Inputs):
    return i.counted(F.col("n") > 20), i.counted(F.col("n") <= 20)


@query("join_full_outer_merge", f", {_HALVES} SELECT coalesce(h.user_id, d.user_id) AS user_id, coalesce(h.mbid, d.mbid) AS mbid, CAST(least(coalesce(h.plays, 0) + coalesce(d.plays, 0), 65535) AS INTEGER) AS plays FROM held h FULL JOIN delta d ON h.user_id = d.user_id AND h.mbid = d.mbid")
def _(i):
    held, delta = (x.withColumnRenamed("mbid", "recording_id") for x in _halves(i))
    return L.merge_plays(held, delta).withColumnRenamed("recording_id", "mbid")  # one aggregation says what the outer join does


query("join_self_similarity", "SELECT x.mbid AS a, y.mbid AS b, count(*) AS shared FROM heard x JOIN heard y ON x.user_id = y.user_id AND x.mbid < y.mbid GROUP BY 1, 2")(lambda i: I.cosine(i.heard).select("a", "b", "shared"))

# Aggregates.
query("agg_count_saturating", "SELECT user_id, event_type AS mbid, CAST(least(count(*), 65535) AS INTEGER) AS plays FROM events GROUP BY 1, 2", inputs=False)(lambda i: L.count_plays(i.table("events").withColumnRenamed("event_type", "recording_mbid")))
query("agg_sum_final", "SELECT user_id, mbid, plays FROM library")(lambda i: i.library)
query("agg_sum_delta", f", {_HALVES} SELECT user_id, recording_id, CAST(sum(plays) AS BIGINT) AS plays FROM (SELECT * FROM held UNION ALL SELECT * FROM delta) JOIN recording USING (mbid) GROUP BY 1, 2")(
    lambda i: (lambda h: h[0].unionByName(h[1]).join(i.recording, "mbid").groupBy("user_id", "recording_id").agg(F.sum("plays").alias("plays")))(_halves(i))
)
query("agg_distinct_key", "SELECT DISTINCT mbid FROM library")(lambda i: i.library.select("mbid").distinct())
query("agg_distinct_pairs", "SELECT recording_id, artist_mbid FROM recording_artist")(lambda i: i.recording_artist)
query("agg_having_count", "SELECT user_id FROM pool")(lambda i: i.pool)
query("agg_listener", "SELECT recording_id, listener, plays FROM recording_listener")(lambda i: i.recording_listener)
query("agg_occurrence", "SELECT user_id, plays, recording FROM occurrence")(lambda i: L.occurrence(i.user_plays))
query("agg_user_total", "SELECT user_id, CAST(sum(recording) AS BIGINT) AS recording, CAST(sum(plays * recording) AS BIGINT) AS heard FROM occurrence GROUP BY 1")(
    lambda i: L.occurrence(i.user_plays).groupBy("user_id").agg(F.sum("recording").alias("recording"), F.sum(F.col("plays") * F.col("recording")).alias("heard"))
)
query("agg_weighted_quantile", "SELECT user_id, round(center, 6) AS center, round(low, 6) AS low, round(high, 6) AS high, recording FROM user_stat")(lambda i: i.user_stat.select("user_id", r("center"), r("low"), r("high"), "recording"))
query("agg_median", "SELECT median(recording) AS usual FROM user_stat")(lambda i: median(i.user_stat, "recording", name="usual"))
query("agg_filtered_count", "SELECT recording_id, island, backer FROM support")(lambda i: i.backing.select("recording_id", "island", "backer"))
query("agg_weighted_vote", "SELECT recording_id, island, round(weight, 6) AS weight FROM support")(lambda i: i.backing.select("recording_id", "island", r("weight")))
query("agg_group_all_having", "SELECT island, mbid, backer, listener, plays, round(score, 6) AS score FROM chosen")(lambda i: i.best.select("island", "mbid", "backer", "listener", "plays", r("score")))
query("agg_affinity", "SELECT island, user_id, round(weight, 6) AS weight FROM affinity")(lambda i: i.affinity.select("island", "user_id", r("weight")))
query("agg_idf", "SELECT mbid, listeners, round(idf, 6) AS idf FROM idf")(lambda i: I.audience_idf(i.heard).select("mbid", "listeners", r("idf")))
_COSINE = ", size AS (SELECT mbid, count(*) AS n FROM heard GROUP BY 1), cosine AS (SELECT a, b, shared, shared / sqrt(s.n * t.n) AS cosine FROM (SELECT x.mbid AS a, y.mbid AS b, count(*) AS shared FROM heard x JOIN heard y ON x.user_id = y.user_id AND x.mbid < y.mbid GROUP BY 1, 2) JOIN size s ON s.mbid = a JOIN size t ON t.mbid = b)"
query("agg_cosine", f"{_COSINE} SELECT a, b, round(cosine, 6) AS cosine FROM cosine")(lambda i: I.cosine(i.heard).select("a", "b", r("cosine")))
query("agg_mean_q", "SELECT island, round(avg(q), 6) AS mean_q FROM island JOIN declared USING (mbid) GROUP BY 1")(lambda i: i.island.join(i.declared, "mbid").groupBy("island").agg(F.round(F.avg("q"), 6).alias("mean_q")))
_PROMISE = "SELECT island, round((avg(q) * any_value(size) + (SELECT avg(q) FROM declared) * 500) / (any_value(size) + 500), 6) AS promise FROM island JOIN declared USING (mbid) JOIN (SELECT island, count(*) AS size FROM cohort GROUP BY 1) USING (island) GROUP BY 1"
query("agg_shrinkage", _PROMISE)(lambda i: I.promise(i.island, i.declared, i.cohort).select("island", r("promise")))
_LIFT = """, tagged AS (SELECT count(DISTINCT mbid) AS tagged FROM genre), lifted AS (SELECT island, token, n, n / size / (overall / tagged) AS lift FROM
  (SELECT island, token, count(*) AS n FROM island JOIN genre USING (mbid) GROUP BY 1, 2) JOIN (SELECT island, count(DISTINCT mbid) AS size FROM island SEMI JOIN genre USING (mbid) GROUP BY 1) USING (island)
  JOIN (SELECT token, count(*) AS overall FROM genre GROUP BY 1) USING (token), tagged WHERE n >= 2 AND n / size >= 0.05),
named AS (SELECT i.island, coalesce(name, 'island ' || i.island) AS name FROM (SELECT DISTINCT island FROM island) i LEFT JOIN
  (SELECT island, string_agg(token, ' / ' ORDER BY r) AS name FROM (SELECT *, row_number() OVER (PARTITION BY island ORDER BY lift DESC, n DESC, token) AS r FROM lifted) WHERE r <= 3 GROUP BY 1) t ON t.island = i.island)"""
query("agg_token_lift", f"{_LIFT} SELECT island, token, n, round(lift, 6) AS lift FROM lifted")(lambda i: I.token_lift(i.island, i.genre).select("island", "token", "n", r("lift")))
query("agg_max_key", "SELECT coalesce(max(recording_id), 0) AS taken FROM recording")(lambda i: i.recording.agg(F.coalesce(F.max("recording_id"), F.lit(0)).alias("taken")))

# Windows.
query("win_surrogate_key", "SELECT recording_id, mbid FROM recording")(lambda i: i.recording)
query("win_surrogate_key_extend", ", held AS (SELECT row_number() OVER (ORDER BY mbid) - 1 AS recording_id, mbid FROM (SELECT DISTINCT mbid FROM library WHERE user_id % 50 = 0)) SELECT recording_id, mbid FROM held UNION ALL SELECT (SELECT coalesce(max(recording_id), 0) FROM held) + row_number() OVER (ORDER BY mbid), mbid FROM (SELECT DISTINCT mbid FROM library) ANTI JOIN held USING (mbid)")(
    lambda i: L.extend_keys(L.surrogate_keys(i.library.where("user_id % 50 = 0")), i.library.select("mbid").distinct())
)
query("win_running_sum", "SELECT user_id, round(x, 6) AS x, CAST(reached AS BIGINT) AS reached FROM running")(lambda i: L.running_listens(L.occurrence(i.user_plays)).select("user_id", r("x"), "reached"))
query("win_rank_per_artist", "SELECT island, mbid, artist_mbid, CAST(rank AS INTEGER) AS rank FROM place")(lambda i: i.per_artist.select("island", "mbid", "artist_mbid", "rank"))
query("win_rank_per_island", "SELECT island, mbid, CAST(row_number() OVER (PARTITION BY island ORDER BY score DESC, mbid) AS INTEGER) AS position FROM chosen")(
    lambda i: numbered(i.best, F.desc("score"), "mbid", name="position", first=1, by=("island",)).select("island", "mbid", F.col("position").cast("int").alias("position"))
)
query("ranked_per_island", "SELECT island, CAST(position AS INTEGER) AS position, mbid, round(score, 6) AS score, backer, listener, plays FROM shown")(lambda i: i.ranked.select("island", "position", "mbid", r("score"), "backer", "listener", "plays"))
query("win_dedupe_name", "SELECT n_nationkey AS island, CASE WHEN t = 1 THEN name ELSE name || ' ' || t END AS name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n_nationkey) AS t FROM (SELECT n_nationkey, 'region ' || n_regionkey AS name FROM nation))", inputs=False)(
    lambda i: I.distinct_names(i.table("nation").select(F.col("n_nationkey").alias("island"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("name")))
)

# Top-k and sorts.
query("topk_global", "SELECT user_id, n FROM top")(lambda i: L.declared_overlap(i.library, i.declared))
query("topk_per_group", "SELECT island, CAST(position AS INTEGER) AS position, mbid FROM shown WHERE position <= 20")(lambda i: I.ranked(i.best, 20).select("island", "position", "mbid"))
query("topk_cohort", "SELECT island, user_id, round(weight, 6) AS weight FROM cohort")(lambda i: i.cohort.select("island", "user_id", r("weight")))
query("sort_promise", f"SELECT island, promise, CAST(row_number() OVER (ORDER BY promise DESC, island) AS INTEGER) AS rank FROM ({_PROMISE})")(
    lambda i: I.promise(i.island, i.declared, i.cohort).select("island", r("promise")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("promise"), "island")))
)
query("topk_tokens", f"{_LIFT} SELECT island, name FROM named")(lambda i: I.names(I.token_lift(i.island, i.genre), i.island))

# Sets.
query("set_union_all", f", {_HALVES} SELECT * FROM held UNION ALL SELECT * FROM delta")(lambda i: (lambda h: h[0].unionByName(h[1]))(_halves(i)))
query("set_union_distinct", "SELECT artist_mbid FROM known")(lambda i: i.known)
query("set_unsupported", "SELECT count(*) AS n FROM declared ANTI JOIN heard USING (mbid)")(lambda i: i.declared.join(i.heard, "mbid", "left_anti").agg(F.count("*").alias("n")))
query("set_requested", f"SELECT DISTINCT mbid FROM (SELECT min(mbid) AS mbid FROM heard UNION SELECT mbid FROM genre WHERE token = (SELECT min(token) FROM genre)) SEMI JOIN heard USING (mbid)")(
    lambda i: I.requested(i.declared, i.heard, i.genre, [i.heard.agg(F.min("mbid")).first()[0]], [i.genre.agg(F.min("token")).first()[0]])
)
query("filter_pin", f"{_LIFT} SELECT island, name FROM named WHERE name LIKE '%e%'")(lambda i: I.pinned(I.names(I.token_lift(i.island, i.genre), i.island), "E"))

# The attraction model, by heard.
_DRAWN = "(SELECT user_id, recording_id, plays, center, low, high FROM user_plays JOIN user_stat USING (user_id))"


def _drawn(i: Inputs):
    return i.drawn, [F.col(c) for c in ("center", "low", "high")]


def _attraction(name, column, sql_column):
    from cadenza.queries.standin import sql_weight

    query(name, f"SELECT user_id, recording_id, round({sql_column}, 6) AS value FROM {sql_weight(_DRAWN)}")(lambda i: (lambda rows, c: rows.select("user_id", "recording_id", F.round(column(*c), 6).alias("value")))(*_drawn(i)))


_attraction("attraction_room", lambda c, lo, hi: A.room(lo, hi), "room")
_attraction("attraction_adopt", lambda c, lo, hi: A.adopt(c, lo, hi), "adopt")
_attraction("attraction_value", lambda c, lo, hi: A.value(F.col("plays"), c, lo, hi), "50 + 50 * drawn")


@query("attraction_weight", f"SELECT user_id, recording_id, round(drawn, 6) AS value FROM {__import__('cadenza.queries.standin', fromlist=['x']).sql_weight(_DRAWN)}")
def _(i):
    A.register(i.spark)
    rows, _ = _drawn(i)
    return rows.select("user_id", "recording_id", F.round(F.expr("attraction_weight(plays, center, low, high)"), 6).alias("value"))


# Scalars of the score.
query("fn_ln_greatest", "SELECT user_id, recording_id, round(ln(greatest(plays, 1)), 6) AS x FROM user_plays")(lambda i: i.user_plays.select("user_id", "recording_id", F.round(F.log(F.greatest("plays", F.lit(1))), 6).alias("x")))
query("fn_pow_damp", "SELECT island, mbid, round(score, 6) AS score FROM candidate")(lambda i: i.scored.select("island", "mbid", r("score")))
query("fn_sqrt_breadth", "SELECT user_id, round(sqrt(greatest(recording, 1) / (SELECT median(recording) FROM user_stat)), 6) AS breadth FROM user_stat")(
    lambda i: i.user_stat.crossJoin(F.broadcast(median(i.user_stat, "recording", name="usual"))).select("user_id", F.round(V.breadth(F.col("recording"), F.col("usual")), 6).alias("breadth"))
)
query("fn_least_greatest_coalesce_case", "SELECT o_orderkey, CAST(least(coalesce(sum(l_quantity * 1000), 0), 65535) AS INTEGER) AS plays FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", inputs=False)(
    lambda i: i.table("orders").join(i.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(V.saturated(F.coalesce(F.sum(F.col("l_quantity") * 1000), F.lit(0)).cast("long")).alias("plays"))
)
query("fn_mod", "SELECT user_id, CAST(user_id % 8 AS INTEGER) AS bucket FROM events GROUP BY 1", inputs=False)(lambda i: i.table("events").select("user_id", V.bucket(F.col("user_id")).alias("bucket")).distinct())
query("fn_unnest", "SELECT recording_mbid, artist FROM (SELECT DISTINCT recording_mbid, unnest(credits) AS artist FROM listens)")(lambda i: i.per_part.select("recording_mbid", F.explode("artist_credit_mbids").alias("artist")).distinct())
query("fn_uuid_cast", f"SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN {sql_mbid('p_partkey')} END AS mbid FROM part", inputs=False)(
    lambda i: i.table("part").select("p_partkey", __import__("cadenza.functions.text", fromlist=["x"]).to_uuid(F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit(" "), F.upper(mbid(F.col("p_partkey"))))).otherwise("no id")).alias("mbid"))
)

# Graph.
def _edges(i: Inputs, threshold: float) -> DataFrame:
    return similar(i.heard, threshold).select("a", "b", F.col("cosine").alias("weight"))


def _communities(i: Inputs, least: int) -> DataFrame:
    return I.communities(lambda loose: I.cosine(i.heard, loose), i.heard.select("mbid").distinct(), 0.05, least=least, edge=_edges(i, 0.05))


query("graph_edges", f"{_COSINE} SELECT a, b, round(cosine, 6) AS weight FROM cosine WHERE cosine >= 0.05")(lambda i: _edges(i, 0.05).select("a", "b", r("weight")))
query("graph_louvain")(lambda i: _communities(i, 1))
query("graph_absorb_small")(lambda i: _communities(i, 4))
query("graph_contract", f"{_COSINE} SELECT least(x.island, y.island) AS a, greatest(x.island, y.island) AS b, round(sum(cosine), 6) AS weight FROM cosine JOIN island x ON x.mbid = a JOIN island y ON y.mbid = b WHERE cosine >= 0.02 GROUP BY 1, 2")(
    lambda i: I.contract(_edges(i, 0.02), i.island.withColumnRenamed("mbid", "node")).select("a", "b", r("weight"))
)
query("graph_symmetric_closure", "SELECT artist_mbid, related_mbid FROM artist_link")(lambda i: i.artist_link)
query("graph_one_hop", "SELECT artist_mbid FROM known")(lambda i: i.known)
query("own_user_decision", "SELECT a.user_id AS own, CAST(floor(100 * a.n / (SELECT count(*) FROM declared)) AS BIGINT) AS coverage, coalesce(b.n, 0) AS runner_up FROM (SELECT * FROM top ORDER BY n DESC, user_id LIMIT 1) a LEFT JOIN (SELECT * FROM top ORDER BY n DESC, user_id LIMIT 1 OFFSET 1) b ON true")(lambda i: i.own)
@query("index_build", "SELECT * FROM (SELECT 'library' AS part, count(*) AS n FROM library UNION ALL SELECT 'recording', count(*) FROM recording UNION ALL SELECT 'user_plays', count(*) FROM user_plays UNION ALL SELECT 'user_stat', count(*) FROM user_stat UNION ALL SELECT 'recording_listener', count(*) FROM recording_listener UNION ALL SELECT 'recording_artist', count(*) FROM recording_artist)")
def _(i):
    """All parts of the index from the raw tables, whatever the session has already."""
    fresh = Inputs(i.spark, i.sf_dir)
    counts = [getattr(fresh, p).agg(F.lit(p).alias("part"), F.count("*").alias("n")) for p in ("library", "recording", "user_plays", "user_stat", "recording_listener", "recording_artist")]
    together = counts[0]
    for more in counts[1:]:
        together = together.unionByName(more)
    return together


query("recommend_all")(lambda i: _recommend(i, threshold=0.05, community=4))
query("recommend_defaults")(lambda i: _recommend(i))


def _recommend(i: Inputs, **options):
    from cadenza.plans.recommend import recommend

    parts = {p: getattr(i, p) for p in ("user_plays", "user_stat", "recording", "recording_artist", "recording_listener", "artist_link")}
    return recommend(parts, i.declared, **options).select("island", "position", "mbid", r("score"), "backer", "listener", "plays")
