"""Scalar functions over titles, names, URLs, times and numbers made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza import schema as S
from cadenza.functions import text as X
from cadenza.functions import values as V
from cadenza.queries.standin import Inputs, mbid, sql_mbid

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs.of(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _case(sql_by_rest: list[str], key: str = "p_partkey") -> str:
    """SQL text that both engines read the same: one of several strings by the key's rest."""
    return "CASE " + " ".join(f"WHEN {key} % {len(sql_by_rest)} = {i} THEN {x}" for i, x in enumerate(sql_by_rest)) + " END"


def _part(i: Inputs, **columns: str):
    """p_partkey and columns given as SQL that Spark and DuckDB share."""
    return i.table("part").select("p_partkey", *[F.expr(sql).alias(name) for name, sql in columns.items()])


# Words and titles.
_WORDS = _case(["concat('  ', upper(p_name), '!! ')", "concat(p_name, ' (Été, n° 5)')", "concat('¿', p_name, '? — ', p_type)", "'***'"])
query("fn_normalize_words", f"SELECT p_partkey, trim(regexp_replace(lower({_WORDS}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS words FROM part")(lambda i: _part(i, s=_WORDS).select("p_partkey", X.normalize_words(F.col("s")).alias("words")))
_TITLES = _case(["p_name", "concat(p_name, ' (Live)')", "concat('[Official] ', p_name)", "concat(p_name, ' (VIP (Extended) Mix)')", "concat(p_name, ' Remastered Version')", "concat('(', p_name, ')')", "concat(p_name, '　リミックス')", "concat(p_name, ' (')"])
query("fn_strip_version", f"SELECT p_partkey, {_case(['p_name', 'p_name', 'p_name', 'p_name', 'p_name', chr(39) * 2, 'p_name', 'p_name'])} AS stripped FROM part")(lambda i: _part(i, s=_TITLES).select("p_partkey", X.strip_version(F.col("s")).alias("stripped")))
query("fn_normalize_title", f"SELECT p_partkey, {_case(['replace(p_name, chr(32), chr(32)[1:0])', 'replace(p_name, chr(32), chr(32)[1:0])', 'replace(p_name, chr(32), chr(32)[1:0])', 'replace(p_name, chr(32), chr(32)[1:0])', 'concat(replace(p_name, chr(32), chr(32)[1:0]), ' + repr('remasteredversion') + ')', chr(39) * 2, 'concat(replace(p_name, chr(32), chr(32)[1:0]), ' + repr('リミックス') + ')', 'replace(p_name, chr(32), chr(32)[1:0])'])} AS title FROM part")(
    lambda i: _part(i, s=_TITLES).select("p_partkey", X.normalize_title(F.col("s")).alias("title"))
)
_ARTISTS = _case(["p_brand", "concat(p_brand, ' & ', p_type)", "concat(p_brand, ' feat. ', p_type, ' x Guest')", "concat(p_brand, ', ', p_type, '; ')", "' / '"])
_NAMES = {"b": "replace(replace(lower(p_brand), '#', ' '), '  ', ' ')", "t": "lower(p_type)"}
query("fn_split_artists", f"SELECT p_partkey, {_case([f'{_NAMES[chr(98)]}', f'concat({_NAMES[chr(98)]}, {chr(39)}|{chr(39)}, {_NAMES[chr(116)]})', f'concat({_NAMES[chr(98)]}, {chr(39)}|{chr(39)}, {_NAMES[chr(116)]}, {chr(39)}|guest{chr(39)})', f'concat({_NAMES[chr(98)]}, {chr(39)}|{chr(39)}, {_NAMES[chr(116)]})', chr(39) * 2])} AS artists FROM part")(
    lambda i: _part(i, s=_ARTISTS).select("p_partkey", F.array_join(X.split_artists(F.col("s")), "|").alias("artists"))
)
query("fn_script_class", "SELECT doc_id, regexp_matches(text, '[A-Za-z]') AS latin, regexp_matches(text, '[^\\x00-\\x7F]') AND regexp_matches(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '\\p{L}') AS other FROM documents")(
    lambda i: i.table("documents").select("doc_id", X.has_latin(F.col("text")).alias("latin"), X.has_other_script(F.col("text")).alias("other"))
)
_KANA = _case(["'さくら'", "'キャット'", "'がっこう'", "'東京'", "p_name", "'ふじ'", "'ニッポン'"])
query("fn_romanize", f"SELECT p_partkey, {_case([repr('sakura'), repr('kyatto'), repr('gakkou'), 'NULL', 'NULL', repr('fuji'), repr('nippon')])} AS romaji FROM part")(lambda i: _part(i, s=_KANA).select("p_partkey", X.romanize(F.col("s")).alias("romaji")))
query("fn_is_latin", f"SELECT p_partkey, p_partkey % 7 = 4 AS latin FROM part")(lambda i: _part(i, s=_KANA).select("p_partkey", X.is_latin(F.col("s")).alias("latin")))
_PREFIXES = {"a": _case(["'ring'", "'ringlight'", "''", "'lamp'"]), "b": _case(["'ringlight'", "'ring'", "'ring'", "'ring'"])}
query("fn_title_prefix_match", "SELECT p_partkey, p_partkey % 4 < 2 AS fits FROM part")(lambda i: _part(i, **_PREFIXES).select("p_partkey", X.title_prefix_match(F.col("a"), F.col("b")).alias("fits")))
_MISS = {"song": "p_partkey % 7 <> 0", "title": "CASE WHEN p_partkey % 5 <> 0 THEN 'x' END", "track": _case(["'ring'", "'lamp'", "'ringlight'"]), "seconds": "CASE WHEN p_partkey % 4 <> 0 THEN p_size END"}
query(
    "fn_mismatch_class",
    "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'not_song' WHEN p_partkey % 5 = 0 THEN 'no_title' WHEN p_partkey % 3 = 1 THEN 'title' WHEN p_partkey % 4 = 0 THEN 'no_duration' WHEN abs(p_size - 20) > 1 THEN 'duration' END AS miss FROM part",
)(lambda i: _part(i, **_MISS).select("p_partkey", X.mismatch_class(F.col("song"), F.col("title"), F.array(F.lit("ring"), F.lit("rings")), F.col("track"), F.col("seconds"), F.lit(20), S.DURATION_TOLERANCE).alias("miss")))
_ENCODED = _case(["concat(p_name, ' & ', p_type)", "'a~b*c-d_e.f'", "'ñ/ü?=%'"])
query("fn_percent_encode", f"SELECT p_partkey, {_case(['concat(replace(p_name, chr(32), chr(37) || 20), chr(37) || 20 || chr(37) || 26 || chr(37) || 20, p_type)', repr('a~b%2Ac-d_e.f'), repr('%C3%B1%2F%C3%BC%3F%3D%25')])} AS encoded FROM part")(
    lambda i: _part(i, s=_ENCODED).select("p_partkey", X.percent_encode(F.col("s")).alias("encoded"))
)

# URLs.
_URLS = _case(["concat('https://soundcloud.com/u/', p_partkey)", "concat('https://www.youtube.com/watch?v=', p_partkey)", "concat('https://music.youtube.com/watch?list=1&v=', p_partkey, '&t=2')", "concat('https://band', p_partkey, '.bandcamp.com/track/x')", "concat('https://band.bandcamp.com/album/', p_partkey)", "concat('http://soundcloud.com/', p_partkey)"])
_SOURCES = _case(["'soundcloud'", "'youtube'", "'youtube_music'", "'bandcamp'", "NULL", "NULL"])
query("fn_classify_url", f"SELECT p_partkey, {_SOURCES} AS source FROM part")(lambda i: _part(i, s=_URLS).select("p_partkey", X.classify_url(F.col("s")).alias("source")))
query("fn_video_id", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 2 THEN CAST(p_partkey AS VARCHAR) END AS video FROM part")(lambda i: _part(i, s=_URLS).select("p_partkey", X.video_id(F.col("s")).alias("video")))
query("fn_canonical_href", """SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url END AS href FROM pages""")(
    lambda i: i.table("pages").select("page_id", X.canonical_href(F.when(F.col("page_id") % 3 != 0, F.concat(F.substring("html", 1, 200), F.lit('<link rel="canonical" href="'), "url", F.lit('">'), "html")).otherwise(F.col("html"))).alias("href"))
)
query("argmin_priority", "SELECT b AS brand, CASE min(p) WHEN 0 THEN 'soundcloud' WHEN 1 THEN 'youtube_music' WHEN 2 THEN 'bandcamp' ELSE 'youtube' END AS source FROM (SELECT p_brand AS b, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 END AS p FROM part WHERE p_partkey % 6 < 4) GROUP BY 1")(
    lambda i: i.table("part").select("p_brand", X.classify_url(F.expr(_URLS)).alias("source")).where("source IS NOT NULL").groupBy(F.col("p_brand").alias("brand")).agg(F.min_by("source", X.source_priority(F.col("source"))).alias("source"))
)
_RELATION = {"kind": _case(["'streaming'", "'free streaming'", "'purchase'"]), "ended": "CASE WHEN p_partkey % 4 = 0 THEN true WHEN p_partkey % 4 = 1 THEN false END", "url": "CASE WHEN p_partkey % 5 <> 0 THEN concat('https://x/', p_partkey) END"}
query("filter_streaming_url", "SELECT p_partkey, 'https://x/' || p_partkey AS url FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 4 <> 0 AND p_partkey % 5 <> 0")(
    lambda i: _part(i, **_RELATION).where(F.col("kind").isin(X.STREAMING_RELATIONS) & ~F.coalesce(F.col("ended"), F.lit(False)) & F.col("url").isNotNull()).select("p_partkey", "url")
)

# Times.
_STAMP = "CASE WHEN event_id % 10 = 0 THEN 'soon' WHEN event_id % 2 = 0 THEN concat({ts}, '.001868+00:00') ELSE concat({ts}, 'Z') END"
query("fn_reach_key", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) ELSE -1 END AS reach FROM events")(
    lambda i: i.table("events").select("event_id", F.coalesce(V.reach_key(F.expr(_STAMP.format(ts="date_format(ts, 'yyyy-MM-dd HH:mm:ss')"))), F.lit(-1)).alias("reach"))
)
_DUMP = "CASE WHEN event_id % 7 = 0 THEN 'notes.txt' ELSE concat('listens-dump-', event_id, '-20240', 1 + event_id % 9, '15-000003-incremental') END"
_REACH = "CAST(concat('20240', 1 + event_id % 9, '15000003') AS BIGINT)"
query("fn_published", f"SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id ELSE -1 END AS number, CASE WHEN event_id % 7 <> 0 THEN {_REACH} ELSE -1 END AS reach FROM events")(
    lambda i: i.table("events").select("event_id", V.published(F.expr(_DUMP)).alias("p")).select("event_id", F.coalesce("p.number", F.lit(-1)).alias("number"), F.coalesce("p.reach", F.lit(-1)).alias("reach"))
)
query("pred_newer", "SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_id END > 100, true) AS newer FROM events")(
    lambda i: i.table("events").select("event_id", V.newer(V.published(F.expr(_DUMP))["number"], F.lit(100)).alias("newer"))
)
query("pred_window_after", f"SELECT concat('listens-dump-', event_id, '-20240', 1 + event_id % 9, '15-000003-incremental') AS name, event_id AS size, event_id AS number, {_REACH} AS reach FROM events WHERE event_id % 7 <> 0 AND {_REACH} > 20240515000000")(lambda i: _pending(i))


def _pending(i: Inputs):
    from cadenza.plans.index import pending

    return pending(i.table("events").select(F.expr(_DUMP).alias("name"), F.col("event_id").alias("size")), 20240515000000)


_DATES = "CASE o_orderkey % 6 WHEN 0 THEN {y} WHEN 1 THEN {ym} WHEN 2 THEN {ymd} WHEN 3 THEN concat({y}, '-??-07') WHEN 4 THEN concat({y}, '-13-01') ELSE 'unknown' END"
query(
    "fn_partial_date",
    "SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN date_trunc('year', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE WHEN 2 THEN o_orderdate::DATE WHEN 3 THEN make_date(year(o_orderdate), 1, 7) END AS VARCHAR) AS released FROM orders",
)(lambda i: i.table("orders").select("o_orderkey", V.partial_date(F.expr(_DATES.format(y="date_format(o_orderdate, 'yyyy')", ym="date_format(o_orderdate, 'yyyy-MM')", ymd="date_format(o_orderdate, 'yyyy-MM-dd')"))).cast("string").alias("released")))
query("fn_days", "SELECT event_id, CAST(greatest(floor((1704412800 - floor(epoch(ts))) / 86400), 0) AS BIGINT) AS days FROM events")(
    lambda i: i.table("events").select("event_id", V.days_since(F.lit(1704412800), F.unix_timestamp("ts")).cast("long").alias("days"))
)
query("fn_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")(lambda i: i.table("events").select("event_id", V.day(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("day")))
query("fn_recent", "SELECT o_orderkey, o_orderdate >= TIMESTAMP '1998-03-28 00:00:00' AS recent FROM orders")(lambda i: i.table("orders").select("o_orderkey", V.recent(F.col("o_orderdate"), F.lit("1998-04-28")).alias("recent")))
query("fn_covered", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN user_id END, event_id) AS covered FROM events")(lambda i: i.table("events").select("event_id", V.covered(F.when(F.col("event_id") % 3 == 0, F.col("user_id")), F.col("event_id")).alias("covered")))

# Numbers.
query("fn_round_sec", "SELECT event_id, CAST(floor((event_id * 337 + 500) / 1000) AS BIGINT) AS seconds FROM events")(lambda i: i.table("events").select("event_id", V.round_seconds(F.col("event_id") * 337).alias("seconds")))
query("fn_fmt_duration", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '?:??' ELSE concat(CAST(floor(event_id / 60) AS BIGINT), ':', lpad(CAST(event_id % 60 AS VARCHAR), 2, '0')) END AS duration FROM events")(
    lambda i: i.table("events").select("event_id", V.duration(F.when(F.col("event_id") % 9 != 0, F.col("event_id"))).alias("duration"))
)
_BIG = "CAST(o_orderkey AS BIGINT) * CAST(o_orderkey AS BIGINT) * CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 997 WHEN 2 THEN 1000003 ELSE 100000007 END AS BIGINT)"
#: The same number where it passes 64 bits, as it does for keys above some 303,700: up to 38 digits.
_WIDE = "CAST(o_orderkey AS DECIMAL(15,0)) * CAST(o_orderkey AS DECIMAL(15,0)) * CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 997 WHEN 2 THEN 1000003 ELSE 100000007 END AS DECIMAL(9,0))"
_SCALED = " ".join(f"WHEN n >= {10**p} THEN concat(CAST(n // {10**p} AS VARCHAR), CASE WHEN n // {10**(p - 1)} % 10 > 0 THEN concat('.', n // {10**(p - 1)} % 10) ELSE '' END, '{u}')" for p, u in ((18, "E"), (15, "P"), (12, "T"), (9, "B"), (6, "M")))
query("fn_human_number", f"SELECT o_orderkey, CASE {_SCALED} WHEN n >= 1000 THEN concat(n // 1000, ' ', lpad(CAST(n % 1000 AS VARCHAR), 3, '0')) ELSE CAST(n AS VARCHAR) END AS number FROM (SELECT o_orderkey, {_BIG} AS n FROM orders)")(
    lambda i: i.table("orders").select("o_orderkey", V.human_number(F.expr(_WIDE)).alias("number"))
)
query("fn_q_floor", "SELECT p_brand, CAST(floor(avg(p_partkey % 5)) AS INTEGER) AS tier FROM part GROUP BY 1")(lambda i: i.table("part").groupBy("p_brand").agg(V.q_floor(F.avg(F.col("p_partkey") % 5)).alias("tier")))
query("proj_rate", "SELECT o_orderkey, round(o_custkey / greatest(o_orderkey % 40, 1), 6) AS rate FROM orders")(lambda i: i.table("orders").select("o_orderkey", F.round(V.rate(F.col("o_custkey"), F.col("o_orderkey") % 40), 6).alias("rate")))

# Names, genres and labels.
_GENRES = _case(["concat(p_type, ' / ', upper(p_name), ' / Music')", "'Other /  / x:y'", "concat(' Pop / ', p_brand)"])
query("fn_genre_tokens", f"SELECT p_partkey, {_case(['concat(lower(p_type), chr(124), p_name)', chr(39) * 2, 'concat(' + repr('pop|') + ', lower(p_brand))'])} AS tokens FROM part")(lambda i: _part(i, s=_GENRES).select("p_partkey", F.array_join(X.genre_tokens(F.col("s")), "|").alias("tokens")))
_ALIASES = "array(named_struct('name', p_name, 'primary', true), named_struct('name', p_brand, 'primary', p_partkey % 2 = 0), named_struct('name', p_type, 'primary', p_partkey % 3 = 0))"
query("fn_other_name", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 3 = 0 THEN p_type END AS other FROM part")(lambda i: _part(i, a=_ALIASES, t="p_name").select("p_partkey", X.other_name(F.col("a"), F.col("t")).alias("other")))
query("fn_subtitle", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' (' || p_type || ')' WHEN 1 THEN p_brand WHEN 2 THEN p_type END AS subtitle FROM part")(
    lambda i: _part(i, a="CASE WHEN p_partkey % 4 < 2 THEN p_brand END", c="CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <= 2 THEN p_type ELSE '' END").select("p_partkey", X.subtitle(F.col("a"), F.col("c")).alias("subtitle"))
)
_CREDITS = "CASE WHEN p_partkey % 3 = 0 THEN array(named_struct('name', p_brand, 'joinphrase', ' feat. '), named_struct('name', p_type, 'joinphrase', CAST(NULL AS STRING))) WHEN p_partkey % 3 = 1 THEN array(named_struct('name', p_brand, 'joinphrase', '')) END"
query("fn_credit_line", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' feat. ' || p_type WHEN 1 THEN p_brand ELSE '?' END AS credit FROM part")(lambda i: _part(i, c=_CREDITS).select("p_partkey", X.credit_line(F.col("c")).alias("credit")))
query("fn_label_join", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' – ' || p_brand WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE '' END AS label FROM part")(
    lambda i: _part(i, t="CASE WHEN p_partkey % 4 < 2 THEN p_name ELSE '' END", a="CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END").select("p_partkey", X.label_join(F.col("t"), F.col("a")).alias("label"))
)
query("fn_strip_prefix_uuid", f"SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN {sql_mbid('p_partkey')} END AS mbid FROM part")(
    lambda i: i.table("part").select("p_partkey", F.array(F.lit("https://x.org/artist/1"), F.concat(F.lit("https://x.org/recording/"), F.when(F.col("p_partkey") % 3 != 0, mbid(F.col("p_partkey"))).otherwise("none"))).alias("u")).select("p_partkey", X.uuid_after("https://x.org/recording/", F.col("u")).alias("mbid"))
)
query("fn_env_bool", "SELECT p_partkey, p_partkey % 5 = 4 AS on_ FROM part")(lambda i: _part(i, s=_case(["'0'", "'False'", "'no'", "' off '", "'yes'"])).select("p_partkey", X.env_bool(F.col("s")).alias("on_")))
query("fn_target_parse", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'artist' ELSE 'user' END AS kind FROM part")(lambda i: i.table("part").select("p_partkey", X.target_kind(F.when(F.col("p_partkey") % 2 == 0, mbid(F.col("p_partkey"))).otherwise(F.col("p_name"))).alias("kind")))
query("set_tag_union", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || [lower(p_type), 'ring'])), ' / ') AS tags FROM part")(
    lambda i: i.table("part").select("p_partkey", X.tag_union(F.split("p_name", " "), F.array(F.lower("p_type"), F.lit("ring"))).alias("tags"))
)
query("form_variants", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '|' || p_brand || '|romaji' ELSE p_name || '|' || p_brand END AS forms FROM part")(
    lambda i: _part(i, t="p_name", a="array(p_brand, '', p_name)", m="CASE WHEN p_partkey % 2 = 0 THEN 'romaji' END").select("p_partkey", F.array_join(X.form_variants(F.col("t"), F.col("a"), F.col("m")), "|").alias("forms"))
)
query("query_variants", "SELECT p_partkey, concat('band ', p_name, '|band ', p_type, '|バンド ', p_name, '|バンド ', p_type, '|バンド 曲') AS texts FROM part")(
    lambda i: _part(i, t="array(p_name, p_type, '曲')").select("p_partkey", F.array_join(X.query_variants(F.col("t"), [F.lit("band"), F.lit("バンド")], 6), "|").alias("texts")).select("p_partkey", F.replace("texts", F.lit("band 曲|"), F.lit("")).alias("texts"))
)


query("topk_dedupe_concat", "SELECT c_custkey, array_to_string(list_transform(list_sort(list(struct_pack(p := p, id := id)))[1:8], lambda x: x.id), ',') AS ids FROM (SELECT o_custkey AS c_custkey, CAST(o_orderkey % 23 AS VARCHAR) AS id, min(o_orderkey) AS p FROM orders GROUP BY 1, 2) GROUP BY 1")(
    lambda i: _dedupe(i)
)


def _dedupe(i: Inputs):
    """Ordered distinct results, eight at most per user."""
    from pyspark.sql import Window

    first = i.table("orders").groupBy(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 23).cast("string").alias("id")).agg(F.min("o_orderkey").alias("p"))
    rank = F.row_number().over(Window.partitionBy("c_custkey").orderBy("p"))
    top = first.withColumn("rank", rank).where("rank <= 8")
    return top.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("ids"))


_CLASS = "CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END"
query("topk_miss", f"SELECT brand, p_partkey, class FROM (SELECT p_brand AS brand, p_partkey, {_CLASS} AS class, row_number() OVER (PARTITION BY p_brand ORDER BY {_CLASS}, abs(p_size - 20), p_partkey) AS r FROM part) WHERE r <= 3")(lambda i: _misses(i))


def _misses(i: Inputs):
    from pyspark.sql import Window

    rows = i.table("part").select(F.col("p_brand").alias("brand"), "p_partkey", F.expr(_CLASS).alias("class"), F.abs(F.col("p_size") - 20).alias("off"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("brand").orderBy("class", "off", "p_partkey"))).where("rank <= 3").select("brand", "p_partkey", "class")
