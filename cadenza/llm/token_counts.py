"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split where no token can cross, in any script: before a single space or line feed that stands
between two characters that are no white space, and between a CJK character and a CJK stop.  A byte-level
pre-tokenizer always starts a new piece there, whatever version of Unicode it knows, and added special strings
hold no such place, so the sum over the pieces is the count of the whole.  Pieces recur, so each task keeps the
counts of short ones (at most ``KEPT`` of them) and encodes the others in batches of about ``batch_bytes``
bytes of UTF-8, each once a batch.  Batches are cut by bytes, not by rows or texts: memory does not depend on
how long texts are.

Edge cases: null and empty texts have no tokens; a text without any safe boundary stays whole; repeated
rows are counted once per row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
BATCH_BYTES = 1 << 16
KEPT, KEPT_LENGTH = 500_000, 48
#: Boundaries inside what stands between two single spaces.
_INNER = re.compile(r"(?<=\S)(?=\n\S)|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])(?=[\u3001\u3002\uff0c\uff01\uff1f])")
#: Pieces up to this length are not looked into.
_PLAIN = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """The text cut at its safe boundaries; joined, the pieces are the text."""
    first, *words = text.split(" ")
    out, open_ = [], first
    for word in words:
        if open_ and word and not open_[-1].isspace() and not word[0].isspace():
            out.append(open_)
            open_ = " " + word
        else:
            open_ += " " + word
    out.append(open_)
    return [cut for piece in out for cut in (_INNER.split(piece) if len(piece) > _PLAIN else (piece,))]


def _encoder(path: str):
    """A function from texts to their numbers of tokens."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def _counter(path: str, batch_bytes: int, splits: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _encoder(path), {}
        for batch in batches:
            totals = [0] * batch.num_rows
            waiting: dict[str, list[int]] = {}  # pieces of the next batch and the rows that have them
            held = 0

            def settle() -> None:
                for (piece, rows), n in zip(waiting.items(), encode(list(waiting)), strict=True):
                    for row in rows:
                        totals[row] += n
                    if len(piece) <= KEPT_LENGTH and len(known) < KEPT:
                        known[piece] = n
                waiting.clear()

            for row, text in enumerate(batch.column("text")):
                text, total = text.as_py(), 0
                for piece in pieces(text) if splits else (text,):
                    n = known.get(piece)
                    if n is not None:
                        total += n
                    elif piece in waiting:
                        waiting[piece].append(row)
                    else:
                        waiting[piece] = [row]
                        held += len(piece) if piece.isascii() else len(piece.encode())
                        if held >= batch_bytes:
                            settle()
                            held = 0
                totals[row] += total
            settle()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(totals, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return count


def count_tokens(docs: DataFrame, path: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_tokens.

    Texts are split only for the byte-level .json tokenizer, where the boundary is known to be safe.
    """
    path = path or tokenizer_path()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = rows.drop("text").schema.add("n_tokens", "long")
    return rows.mapInArrow(_counter(path, batch_bytes, path.endswith(TOKENIZER)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
