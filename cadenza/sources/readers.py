"""Readers: shards, tab-separated tables, declarations, JSON payloads and text files, with fixed schemas."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import schema as S
from cadenza.functions import text as X
from cadenza.sources.sinks import staged


def shards(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """Every parquet file of a folder; other files are left out.  Only columns in use are read."""
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    return (reader.schema(schema) if schema else reader).parquet(folder)


def shard_list(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    if not paths:
        raise ValueError("no shards")
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def bucket(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """One bucket of a table written by bucket: the other folders are pruned."""
    return spark.read.parquet(folder).where(F.col("bucket") == k)


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, stem, size): the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size"))


def tsv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    r"""Headerless, tab-delimited, no quotes or escapes, \N is null, all text."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, sep="\t", quote="", escape="", nullValue="\\N", schema=schema)


_BLANK = re.compile(r"(?:\s|//[^\n]*)*")
_COMMENT = re.compile(r"/\*|\*/")
_RAW = re.compile(r'r(#*)"')
_TEXT = re.compile(r'"((?:[^"\\]|\\.)*)"', re.DOTALL)
_NUMBER = re.compile(r"[+-]?(?:0x[0-9A-Fa-f_]+|0b[01_]+|0o[0-7_]+|[0-9][0-9_]*)(?![\w.])")
_WORD = re.compile(r"(?:r#)?[A-Za-z_]\w*")
_SIGN = re.compile(r"[()\[\],:#!]")
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]{1,6})\}|(.))", re.DOTALL)
#: What a character behind a backslash stands for.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "'": "'"}
#: Names that may be enabled at the head of a declaration; none of them changes what a list of entries means.
_EXTENSIONS = ("implicit_some", "unwrap_newtypes", "unwrap_variant_newtypes", "explicit_struct_names")


class DeclarationError(Exception):
    def __init__(self, message: str, place: int):
        super().__init__(message)
        self.message, self.place = message, place


def _past_blanks(text: str, at: int) -> int:
    """The next place that is no white space and in no comment; block comments hold others."""
    while True:
        at = _BLANK.match(text, at).end()
        if not text.startswith("/*", at):
            return at
        start, depth = at, 0
        for mark in _COMMENT.finditer(text, at):
            depth += 1 if mark[0] == "/*" else -1
            if depth == 0:
                at = mark.end()
                break
        else:
            raise DeclarationError("comment without an end", start)


def _unescaped(text: str, at: int) -> str:
    def said(m: re.Match) -> str:
        if m[3] is not None and m[3] not in _ESCAPES:
            raise DeclarationError(f"unknown escape {m[0]}", at + m.start())
        code = int(m[1] or m[2] or "0", 16)
        if m[3] is None and (code > 0x10FFFF or 0xD800 <= code < 0xE000):
            raise DeclarationError(f"no character: {m[0]}", at + m.start())
        return chr(code) if m[3] is None else _ESCAPES[m[3]]

    return _ESCAPE.sub(said, text)


def _tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, value, place) of a declaration's tokens; blanks and comments are left out, the end is a token too."""
    at = 1 if text.startswith("\ufeff") else 0
    while (at := _past_blanks(text, at)) < len(text):
        if raw := _RAW.match(text, at):
            end = text.find('"' + raw[1], raw.end())
            if end < 0:
                raise DeclarationError("text without an end", at)
            yield "text", text[raw.end() : end], at
            at = end + 1 + len(raw[1])
        elif found := _TEXT.match(text, at):
            yield "text", _unescaped(found[1], at + 1), at
            at = found.end()
        elif found := _NUMBER.match(text, at):
            yield "number", str(int(found[0].replace("_", ""), 0) if found[0].lstrip("+-")[:1] == "0" and found[0].lstrip("+-")[1:2] in ("x", "b", "o") else int(found[0].replace("_", ""))), at
            at = found.end()
        elif found := _WORD.match(text, at) or _SIGN.match(text, at):
            yield "sign" if found.re is _SIGN else "word", found[0].removeprefix("r#"), at
            at = found.end()
        else:
            raise DeclarationError("unexpected character", at)
    yield "end", "", at


def _id(value: str) -> str | None:
    """An id in any of its forms (with or without hyphens, in braces, as a URN), as it is compared; None if it is none."""
    plain = value.lower()
    plain = plain.removeprefix("urn:uuid:") if plain.startswith("urn:uuid:") else plain[1:-1] if plain[:1] + plain[-1:] == "{}" else plain
    if re.fullmatch("[0-9a-f]{32}", plain) and plain == value.lower():
        plain = "-".join((plain[:8], plain[8:12], plain[12:16], plain[16:20], plain[20:]))
    return plain if re.fullmatch(X.UUID, plain) else None


def parse_declaration(text: str, needs_playlist: bool = False) -> list[tuple[str, int, list[str]]]:
    """(s, q, playlist) of the entries of a declaration: a list of (s: "uuid", q: 0..4, playlist: ["a", "b"]), over as
    many lines as one likes, fields in any order, with // and (nested) /* */ comments and commas behind last items.

    Texts may be raw (r#"..."#) or hold escapes, numbers may be signed, hexadecimal, octal or binary and hold underscores,
    entries may bear the name ``Entry``, and extensions may be enabled at the head.  An entry without playlist has an
    empty one, or is an error if ``needs_playlist``.
    """
    tokens = list(_tokens(text))
    at = 0

    def take(kind: str, value: str | None = None) -> str | None:
        nonlocal at
        if tokens[at][0] == kind and value in (None, tokens[at][1]):
            at += 1
            return tokens[at - 1][1]
        return None

    def need(kind: str, value: str | None = None) -> str:
        found = take(kind, value)
        if found is None:
            raise DeclarationError(f"expected {value or kind}", tokens[at][2])
        return found

    def items(last: str, item) -> list:
        out = []
        while take("sign", last) is None:
            out.append(item())
            if take("sign", ",") is None:
                need("sign", last)
                break
        return out

    def texts() -> list[str]:
        need("sign", "[")
        return items("]", lambda: need("text"))

    def field() -> tuple[str, object, int]:
        place = tokens[at][2]
        name = need("word")
        need("sign", ":")
        if name not in ("s", "q", "playlist"):
            raise DeclarationError(f"unknown field {name}", place)
        place = tokens[at][2]
        return name, texts() if name == "playlist" else need("text" if name == "s" else "number"), place

    def entry() -> tuple[str, int, list[str]]:
        place = tokens[at][2]
        if (called := take("word")) not in (None, "Entry"):
            raise DeclarationError(f"expected Entry, not {called}", place)
        need("sign", "(")
        fields: dict = {}
        for name, value, where in items(")", field):
            if name in fields:
                raise DeclarationError(f"duplicate field {name}", where)
            if name == "s":
                given, value = value, _id(value)
                if value is None:
                    raise DeclarationError(f"no id: {given}", where)
            fields[name] = value, where
        for name in ("s", "q", "playlist") if needs_playlist else ("s", "q"):
            if name not in fields:
                raise DeclarationError(f"missing field {name}", place)
        (s, _), (q, where) = fields["s"], fields["q"]
        if not 0 <= int(q) <= 4:
            raise DeclarationError(f"{s}: q {q} out of range 0..=4", where)
        return s, int(q), fields.get("playlist", ([], 0))[0]

    def extension() -> None:
        place = tokens[at][2]
        if (name := need("word")) not in _EXTENSIONS:
            raise DeclarationError(f"unknown extension {name}", place)

    while take("sign", "#"):
        need("sign", "!")
        need("sign", "[")
        need("word", "enable")
        need("sign", "(")
        items(")", extension)
        need("sign", "]")
    need("sign", "[")
    out = items("]", entry)
    need("end")
    return out


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for text in files["value"]:
            try:
                rows = [(*entry, None) for entry in parse_declaration(text)]
            except DeclarationError as e:
                line = text.count("\n", 0, e.place) + 1
                rows = [(None, None, None, f"line {line}, column {e.place - text.rfind(chr(10), 0, e.place)}: {e.message}")]
            yield pd.DataFrame(rows, columns=["s", "q", "playlist", "problem"]).astype({"q": "Int64"})


def declaration(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a declaration file, which is written by hand and read whole.

    Raises on what is no declaration, with line and column, on a q outside 0 to 4 and on an id that is declared twice.
    """
    rows = staged(spark.read.text(path, wholetext=True).mapInPandas(_parsed, "s string, q long, playlist array<string>, problem string"), "declaration")
    if problem := rows.where("problem IS NOT NULL").select("problem").first():
        raise ValueError(f"{path}: {problem['problem']}")
    return checked(rows.select("s", F.col("q").cast("int").alias("q"), "playlist"))


def checked(rows: DataFrame) -> DataFrame:
    problems = rows.groupBy("s").agg(F.count("*").alias("n"), F.max(~F.coalesce(F.col("q").between(0, 4), F.lit(False))).alias("bad")).where("n > 1 OR bad").orderBy("s").limit(5).collect()
    if problems:
        raise ValueError("; ".join(f"{r['s']}: {'q out of range' if r['bad'] else 'declared twice'}" for r in problems))
    return rows


STATS = "struct<payload:struct<offset:int,recordings:array<struct<recording_mbid:string,listen_count:bigint,track_name:string,artist_name:string>>>>"
CF_PAGE = "struct<payload:struct<offset:int,count:int,total_mbid_count:int,mbids:array<struct<recording_mbid:string,score:double,latest_listened_at:string>>>>"
POPULARITY = "array<struct<recording_mbid:string,total_listen_count:bigint,total_user_count:bigint>>"
PLAYLISTS = "struct<playlists:array<struct<playlist:struct<date:string,identifier:string,source_patch:string,track:array<struct<identifier:array<string>>>>>>>"
CATALOGUE = "struct<offset:int,count:int,recordings:array<struct<id:string,first_release_date:string>>>"


def json_stats(pages: DataFrame, body: str = "body", page: str = "page") -> DataFrame:
    """(mbid, count, track, artist) of paged statistics; rows without id are dropped, the later page wins."""
    rows = pages.select(page, F.posexplode(F.from_json(body, STATS)["payload"]["recordings"]).alias("at", "r"))
    named = rows.select(page, "at", X.to_uuid(F.col("r.recording_mbid")).alias("mbid"), "r").where("mbid IS NOT NULL")
    last = named.groupBy("mbid").agg(F.max_by("r", F.struct(page, "at")).alias("r"))
    return last.select("mbid", F.col("r.listen_count").alias("count"), F.col("r.track_name").alias("track"), F.col("r.artist_name").alias("artist"))


def json_cf(pages: DataFrame, body: str = "body") -> DataFrame:
    """(position, mbid, score, latest_listened_at); a page at or behind the total, or without rows, ends the feed."""
    parsed = pages.select(F.from_json(body, CF_PAGE)["payload"].alias("p")).where("p.offset < p.total_mbid_count")
    rows = parsed.select("p.offset", F.posexplode("p.mbids").alias("at", "m"))
    return rows.select((F.col("offset") + F.col("at")).alias("position"), X.to_uuid(F.col("m.recording_mbid")).alias("mbid"), "m.score", "m.latest_listened_at").where("mbid IS NOT NULL")


def json_popularity(pages: DataFrame, body: str = "body") -> DataFrame:
    rows = pages.select(F.explode(F.from_json(body, POPULARITY)).alias("r"))
    return rows.select(X.to_uuid(F.col("r.recording_mbid")).alias("mbid"), F.coalesce("r.total_listen_count", F.lit(0)).alias("heard"), F.coalesce("r.total_user_count", F.lit(0)).alias("user"))


def json_playlists(pages: DataFrame, body: str = "body") -> DataFrame:
    """(week, identifier, source_patch, track): one row per playlist."""
    rows = pages.select(F.explode(F.from_json(body, PLAYLISTS)["playlists"]).alias("p"))
    return rows.select(F.to_date("p.playlist.date").alias("week"), "p.playlist.identifier", "p.playlist.source_patch", "p.playlist.track")


def tracks(playlists: DataFrame, prefix: str) -> DataFrame:
    """(identifier, position, mbid): positions are given before tracks without a recording are dropped."""
    rows = playlists.select("identifier", F.posexplode("track").alias("position", "t"))
    return rows.select("identifier", "position", X.uuid_after(prefix, F.col("t.identifier")).alias("mbid")).where("mbid IS NOT NULL")


def json_catalogue(pages: DataFrame, body: str = "body") -> DataFrame:
    from cadenza.functions.values import partial_date

    parsed = pages.select(F.from_json(body, CATALOGUE).alias("c")).where("c.offset < c.count")
    rows = parsed.select(F.explode("c.recordings").alias("r"))
    return rows.select(X.to_uuid(F.col("r.id")).alias("mbid"), partial_date(F.col("r.first_release_date")).alias("released")).where("mbid IS NOT NULL")


def m3u(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct ids of a playlist file; comments and files that are not named by an id are skipped."""
    stem = F.regexp_extract(value, r"([^/]*)\.[A-Za-z0-9]+$", 1)
    return lines.where(~F.startswith(F.col(value), F.lit("#"))).select(X.to_uuid(stem).alias("mbid")).where("mbid IS NOT NULL").distinct()


def rsync_listing(lines: DataFrame, value: str = "value") -> DataFrame:
    """(name, size) from `mode size date time name` lines; sizes may hold commas."""
    pattern = r"^\S+\s+([0-9,]+)\s+[0-9/]+\s+[0-9:]+\s+(.+)$"
    rows = lines.where(F.col(value).rlike(pattern)).select(F.regexp_extract(value, pattern, 2).alias("name"), F.replace(F.regexp_extract(value, pattern, 1), F.lit(","), F.lit("")).cast("long").alias("size"))
    return rows.where(~F.col("name").isin(".", ".."))


#: A range of lines is sorted by one task when something is carried down a file.
RANGE_LINES = 1 << 18


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, value): the lines of a text file, or of a folder's files in the order of their names, numbered from 0."""
    return _ranged_lines(spark, path).select("number", "value")


def _ranged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, value, range): :func:`numbered_lines` with the number of the range that a line was read in.

    Files are read in ranges of bytes; a line belongs to the range where it starts.  A task numbers the lines of its
    ranges as it reads them, and the counts of the ranges before, one row per range, say where a range begins.  What
    is counted as a range here has ``RANGE_LINES`` lines at most.
    """
    place = {"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_read": F.monotonically_increasing_id()}
    lines = staged(spark.read.text(path).select("value", *[c.alias(n) for n, c in place.items()]), "lines")
    lines = lines.withColumn("_cut", F.call_function("div", F.col("_read"), F.lit(RANGE_LINES).cast("long")))
    keys = ["_path", "_start", "_cut"]
    ranges = lines.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_read").alias("_first"))
    order = Window.orderBy(*keys)
    above = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.withColumns({"_before": F.coalesce(above, F.lit(0)), "range": F.row_number().over(order)})
    return lines.join(F.broadcast(offsets.drop("_n")), keys).select((F.col("_before") + F.col("_read") - F.col("_first")).alias("number"), "value", "range")


def git_log_file(spark: SparkSession, path: str) -> DataFrame:
    """:func:`git_log` of a written log; lines and commits are named by their numbers in it."""
    return git_log(_ranged_lines(spark, path), ranges="range")


def git_log(lines: DataFrame, number: str = "number", value: str = "value", ranges: str | None = None) -> DataFrame:
    """(commit, at, line, sign, mbid, rest) from `git log -p` text: seconds on a line of their own, then a diff.

    Each line's commit is the last one above it: a running maximum over ranges of lines, those of the column ``ranges`` if
    it is given.  Lines that are neither are left out first.
    """
    from cadenza.operators.ordered import running_max

    head, entry = r"^[0-9]{9,11}$", rf'^([+-])\s*\(.*s:\s*"({X.UUID})"(.*)$'
    at = F.when(F.col(value).rlike(head), F.struct(F.col(number), F.col(value).cast("long").alias("at")))
    marked = running_max(lines.where(F.col(value).rlike(head) | F.col(value).rlike(entry)), at, number, name="head", ranges=ranges)
    rows = marked.where(F.col(value).rlike(entry) & F.col("head").isNotNull())
    return rows.select(F.col(f"head.{number}").alias("commit"), "head.at", F.col(number).alias("line"), *[F.regexp_extract(value, entry, i).alias(n) for i, n in ((1, "sign"), (2, "mbid"), (3, "rest"))])


def source_patch(extension: Column) -> Column:
    return F.get_json_object(extension, "$.additional_metadata.algorithm_metadata.source_patch")


def declared(spark: SparkSession, entries: Sequence[tuple]) -> DataFrame:
    """Entries that are already in memory, (s, q, playlist)."""
    return checked(spark.createDataFrame(list(entries), S.DECLARATION))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of archives, to be compared with a list of digests."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
