"""WARC: seekable Zstandard bundles.

Records are written as WARC/1.1, grouped into frames of about ``FRAME_BYTES``; each frame is a Zstandard
frame of its own.  A bundle is a file of such frames and ends with a skippable frame that holds a seek
table (compressed and decompressed size of every frame) and its footer, so that standard tools read the
bundle as one stream and a reader with the footer can fetch any single frame.  An index table maps record
ids to (bundle, frame, offset inside the frame).

Of records whose payloads are equal and at least ``MIN_REVISIT`` bytes long, the one with the largest id is
the response and the others are revisits that refer to it, without payload.

Bundles are written by tasks to a folder of the shared file system, under a name made of their content's
hash, first to a temporary name; a repeated or speculative attempt writes the same file again.  The index
is written once all bundles are.

Edge cases: null payloads are empty; empty and small payloads are always responses; repeated rows that
share the largest id are all responses; records with null id or url have empty values in their headers
and come back null, the former as responses; extra columns are ignored; an empty table gives
no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import marks, materialize, run_dir, sieve, split, table

MIN_REVISIT = 1000
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3
_FOOTER = struct.Struct("<IBI")  # frames, descriptor, magic
#: Fixed values of the seekable format: a skippable frame's magic number and the footer's.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
_INDEX = "bundle string, frame int, frame_start long, frame_bytes long, record_id string, record_start long"


def _filesystem(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else "file://" + folder)


def decide(records: DataFrame) -> DataFrame:
    """(id, digest, refers_to) of the records that are revisits; records have id, url and payload.

    Only keys are shuffled, and maxima are taken in the reading tasks first.  A payload of very many records is
    one key of the join; its rows are an id and a digest each, and adaptive execution cuts such a partition.
    """
    keyed = records.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= MIN_REVISIT).drop("size")
    groups = keyed.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "repeated-payloads")
    return sieve(keyed, groups, "digest").join(groups, "digest").where("id < refers_to").select("id", "digest", "refers_to").distinct()


def encode_record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def decode_records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of each record of a decompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        version, *lines = frame[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        size = int(headers["Content-Length"])
        yield at, headers, frame[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class _Bundle:
    """Writes frames as they come, to a hidden file; a bundle that is finished gets a name of its own.

    A task that is tried again, or twice at once, leaves bundles under other names: only those count that the
    committed index names.
    """

    def __init__(self, folder: str, write_id: str, level: int):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.fs, self.root = _filesystem(folder)
        self.name = f"{write_id}-{uuid.uuid4().hex}.warc.zst"
        self.part = f"{self.root}/.{self.name}.writing"
        self.out = self.fs.open_output_stream(self.part)
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[int, int, str, int]] = []  # frame, start of the frame, record, its offset
        self.written = 0

    def add_frame(self, records: list[tuple[str, bytes]]) -> None:
        start, plain = 0, b"".join(r for _, r in records)
        for record_id, record in records:
            self.index.append((len(self.sizes), self.written, record_id, start))
            start += len(record)
        packed = self.compress(plain)
        self.out.write(packed)
        self.sizes.append((len(packed), len(plain)))
        self.written += len(packed)

    def seek_table(self) -> bytes:
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes) + _FOOTER.pack(len(self.sizes), 0, _SEEKABLE)
        return struct.pack("<II", _SKIPPABLE, len(entries)) + entries

    def save(self) -> pd.DataFrame:
        self.out.write(self.seek_table())
        self.out.close()
        self.fs.move(self.part, f"{self.root}/{self.name}")
        packed = [self.sizes[f][0] for f, *_ in self.index]
        return pd.DataFrame([(self.name, f, at, size, r, start) for (f, at, r, start), size in zip(self.index, packed, strict=True)], columns=[c.split()[0] for c in _INDEX.split(", ")])


def _writer(folder: str, write_id: str, frame_bytes: int, bundle_bytes: int, level: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, frame, held = None, [], 0
        for rows in batches:
            for id_, url, payload, digest, refers_to in zip(rows["id"], rows["url"], rows["payload"], rows["digest"], rows["refers_to"], strict=True):
                record = encode_record(id_ or "", url, payload.encode(), digest, refers_to)
                frame.append((id_ or "", record))
                held += len(record)
                if held >= frame_bytes:
                    bundle = bundle or _Bundle(folder, write_id, level)
                    bundle.add_frame(frame)
                    frame, held = [], 0
                    if bundle.written >= bundle_bytes:
                        yield bundle.save()
                        bundle = None
        if frame:
            bundle = bundle or _Bundle(folder, write_id, level)
            bundle.add_frame(frame)
        if bundle:
            yield bundle.save()

    return write


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, write_id: str | None = None) -> DataFrame:
    """Write ``records`` (id, url, payload) as bundles below ``folder`` and return the index table of this write.

    Payloads stay in the task that reads them, unless their record may be a revisit.  The index is committed to
    ``folder``/index when all tasks are done; bundles of this write that it does not name, which lost or repeated
    attempts of tasks have left, are deleted.  Several writes may share a folder.
    """
    write_id = write_id or uuid.uuid4().hex[:12]
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    records = records.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    revisits = materialize(decide(records), "revisits")
    k1, _ = marks("id", "digest")
    revisits = revisits.select(k1.alias("mark"), F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("refers_to").cast("string").alias("refers_to"))
    maybe, rest = split(records.withColumn("digest", F.sha1("payload")).withColumn("mark", k1), revisits, "mark")
    found = maybe.join(revisits.drop("mark"), (F.col("id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    both = rest.withColumn("refers_to", F.lit(None).cast("string")).unionByName(found.drop("r_id", "r_digest"))
    rows = both.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", "refers_to")
    index = materialize(rows.mapInPandas(_writer(folder, write_id, frame_bytes, bundle_bytes, level), _INDEX), "warc-index")
    index.write.mode("append").parquet(f"{folder}/index")
    sweep(records.sparkSession, folder, write_id)
    return index


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The index of everything that was written to ``folder``."""
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def sweep(spark: SparkSession, folder: str, write_id: str) -> None:
    """Delete the bundles of a write that is over and that its index does not name."""
    # Only names are read here: the binary source leaves out the content column.
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{write_id}-*.warc.zst").load(folder)
    orphans = files.select(F.element_at(F.split("path", "/"), -1).alias("bundle")).join(committed(spark, folder).select("bundle").distinct(), "bundle", "left_anti")
    fs, root = _filesystem(folder)
    for r in orphans.toLocalIterator():  # as many as attempts were lost
        fs.delete_file(f"{root}/{r['bundle']}")


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(start, packed size, plain size) of each frame, from the footer of an open bundle."""
    end = source.size()
    source.seek(end - _FOOTER.size)
    frames, _, magic = _FOOTER.unpack(source.read(_FOOTER.size))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    source.seek(end - _FOOTER.size - 8 * frames)
    sizes = list(struct.iter_unpack("<II", source.read(8 * frames)))
    starts, at = [], 0
    for packed, plain in sizes:
        starts.append((at, packed, plain))
        at += packed
    return starts


def _frame_lister(folder: str):
    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _filesystem(folder)
        for rows in batches:
            for bundle in rows["bundle"]:
                with fs.open_input_file(f"{root}/{bundle}") as source:
                    yield pd.DataFrame([(bundle, *f) for f in read_seek_table(source)], columns=["bundle", "start", "packed", "plain"])

    return frames


def _frame_reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        fs, root = _filesystem(folder)
        unpack = zstandard.ZstdDecompressor().decompress  # a frame's header holds its plain size
        for rows in batches:
            for bundle, start, packed in zip(rows["bundle"], rows["start"], rows["packed"], strict=True):
                with fs.open_input_file(f"{root}/{bundle}") as source:
                    source.seek(start)
                    frame = unpack(source.read(packed))
                out = []
                for at, headers, payload in decode_records(frame):
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = headers["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record at {bundle}:{start}+{at}")
                    name = lambda h: headers.get(h, "").removeprefix("<urn:page:").removesuffix(">") or None
                    out.append((name("WARC-Record-ID"), headers["WARC-Target-URI"] or None, kind, int(headers["X-Payload-Length"]), digest, name("WARC-Refers-To"), payload if kind == "response" else None))
                yield pd.DataFrame(out, columns=["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return read


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles that ``folder``'s index names; a task reads single frames by their footers' offsets.

    Columns: id, url, record_type, payload_bytes, payload_digest (hex), refers_to, payload (binary, null for revisits).
    """
    bundles = committed(spark, folder).select("bundle").distinct()
    frames = materialize(bundles.mapInPandas(_frame_lister(folder), "bundle string, start long, packed long, plain long"), "warc-frames")
    spread = frames.repartition(F.col("bundle"), F.col("start"))
    return spread.mapInPandas(_frame_reader(folder), "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def lookup(index: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """The records named by ``ids`` (record_id), fetched frame by frame through the index."""
    wanted = index.join(ids.select("record_id").distinct(), "record_id")
    frames = wanted.select("bundle", F.col("frame_start").alias("start"), F.col("frame_bytes").alias("packed")).distinct()
    records = frames.mapInPandas(_frame_reader(folder), "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")
    return records.join(ids.select(F.col("record_id").alias("id")).distinct(), "id", "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_bundles(pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload")), folder)
    back = read_bundles(spark, folder)
    return back.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
best AS (SELECT html, max(page_id) AS best FROM page WHERE n >= {MIN_REVISIT} GROUP BY html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(page.html) AS payload_digest,
       CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < best THEN best END AS refers_to
FROM page LEFT JOIN best ON page.html = best.html
"""
