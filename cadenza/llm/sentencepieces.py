"""SentencePiece encoding and decoding: exact merges by backtracking over longest matches.

A merge-type model starts from single characters and, over and over, joins the neighbouring pair whose
concatenation has the best score, leftmost first.  A row of pieces is that encoding exactly if each two
neighbours are *compatible*: merging the characters of the two alone ends in the two.  So a text is encoded from
left to right: at each place the longest piece that starts there (one Aho-Corasick pass finds all of them) is
tried, then shorter ones, until one is compatible with the piece before; a place from which no piece works is
marked in a bitfield and never tried again, and the piece before gives way.  Compatibility is decided by merging
again and kept for pairs that recur.  Each place is tried at most once per piece that starts or ends there, so
time is linear in the text.

Texts are cut first where no piece of the vocabulary can cross: between two characters that stand side by side
in no piece.  Encoded stretches recur, so each task keeps those of short ones (``KEPT`` at most).  Characters
that the vocabulary lacks become their UTF-8 bytes.  The vocabulary must be one of merges with byte pieces and
an unchanged text but for spaces; others are refused.

Edge cases: null and empty texts encode to begin and end only and decode to the empty text; texts of any length
and script, without any place to cut too, take time in proportion; repeated rows are encoded once per row; a
row whose ids are null decodes to the empty text; extra columns are kept, but the new column must have a free name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table

MODEL = "piece_bpe_32k.model"
#: U+2581 stands for a space in pieces.
MARK = "▁"
KEPT, KEPT_LENGTH, KEPT_PAIRS = 250_000, 48, 500_000
#: About so many bytes of results go back at once.
SENT_BYTES = 1 << 22
#: A pair's number is the left piece's above this factor and the right one's; both lie within half of it.
_BASE = 1 << 22
#: Stretches between marks up to this length are not cut further.
_PLAIN = 64
NEVER = float("inf")
_STRETCHES = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """A model's pieces: normal ones by text, byte pieces by value, and the ids that stand for no text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        named = [model.id_to_piece(i) for i in ids]
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        byte_ids = [i for i in ids if model.is_byte(i)]
        self.byte_ids = {int(named[i][3:-1], 16): i for i in byte_ids}
        silent = {i for i in ids if model.is_control(i)}
        self.ids = {named[i]: i for i in ids if i not in silent and i != self.unknown and i not in set(byte_ids)}
        self.rank = {piece: -model.get_score(i) for piece, i in self.ids.items()}
        probe = f"A ÅÅ  Ａ {MARK}x "
        if len(self.byte_ids) != 256 or any(model.is_unused(i) for i in ids) or model.normalize(probe) != normalized(probe):
            raise ValueError(f"{path}: not a merge-type model with byte pieces and unchanged text")
        #: What an id says, as bytes; the unknown id has a text of its own.
        self.says = [b"" if i in silent else bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(named)]
        self.says[self.unknown] = model.decode([self.unknown]).encode()
        self.is_byte, self.silent = frozenset(byte_ids), frozenset(silent)
        self.little = [i.to_bytes(4, "little") for i in ids]
        #: Characters that stand side by side in some piece.
        self.touching = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.cut_at_marks = not any(pair[1] == MARK and pair[0] != MARK for pair in self.touching)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalized(text: str) -> str:
    """A space before a text that has any character, and marks for spaces."""
    return MARK + text.replace(" ", MARK) if text else ""


class Encoder:
    """Texts to ids, by backtracking.  A character that is no piece goes by the complement of its code point."""

    def __init__(self, path: str):
        import ahocorasick

        self.vocabulary = vocab = vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        self.size = [0] * len(vocab.says)
        self.text = {i: piece for piece, i in vocab.ids.items()}
        for piece, i in vocab.ids.items():
            self.automaton.add_word(piece, i)
            self.size[i] = len(piece)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.packed: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging, for the few characters of two pieces."""
        rank, parts = self.vocabulary.rank, list(text)
        ranks = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        return parts

    def check(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters again ends in the two; for ``left`` = 0, in ``right`` alone."""
        a, b = (self.text.get(i) or chr(~i) if i else "" for i in (left, right))
        good = self.merged(a + b) == ([a, b] if a else [b])
        if len(self.compatible) < KEPT_PAIRS:
            self.compatible[left * _BASE + right] = good
        return good

    def starts(self, text: str) -> list[list[int]]:
        """For each place the pieces that start there, shortest first; one of a single character is always among them."""
        size = self.size
        found: list[list[int]] = [[] for _ in text]
        for end, i in self.automaton.iter(text):
            found[end + 1 - size[i]].append(i)
        for at, here in enumerate(found):
            if not here or size[here[0]] != 1:
                here.insert(0, ~ord(text[at]))
        return found

    def backtracked(self, text: str) -> list[int]:
        """The pieces of a text without begin and end."""
        found, size, known, check, upto = self.starts(text), self.size, self.compatible.get, self.check, len(text)
        failed, any_failed = bytearray((upto >> 3) + 1), False
        pieces: list[int] = []
        tried: list[int] = []  # for each piece, how many shorter ones its place has left
        at = before = 0
        left = len(found[0]) if text else 0
        while at < upto:
            here = found[at]
            while left:
                left -= 1
                piece = here[left]
                end = at + (size[piece] if piece > 0 else 1)
                if any_failed and failed[end >> 3] >> (end & 7) & 1:
                    continue
                good = known(before * _BASE + piece)
                if check(before, piece) if good is None else good:
                    pieces.append(piece)
                    tried.append(left)
                    at, before = end, piece
                    if at < upto:
                        left = len(found[at])
                    break
            else:
                # The pieces before a place are the same whenever it is reached: it fails once and for all.
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece, left = pieces.pop(), tried.pop()
                at -= size[piece] if piece > 0 else 1
                before = pieces[-1] if pieces else 0
        return pieces

    def stretches(self, text: str) -> list[str]:
        """The text cut where no piece can cross; joined, the stretches are the text."""
        vocab = self.vocabulary
        out = []
        for part in _STRETCHES.findall(text) if vocab.cut_at_marks else [text]:
            if len(part) <= _PLAIN:
                out.append(part)
                continue
            start, touching = 0, vocab.touching
            for i in range(1, len(part)):
                if part[i - 1 : i + 1] not in touching:
                    out.append(part[start:i])
                    start = i
            out.append(part[start:])
        return out

    def pack(self, stretch: str) -> bytes:
        """A stretch's ids as little-endian unsigned 32-bit integers."""
        vocab = self.vocabulary
        packed = b"".join([vocab.little[i] if i > 0 else b"".join(vocab.little[vocab.byte_ids[b]] for b in chr(~i).encode()) for i in self.backtracked(stretch)])
        if len(stretch) <= KEPT_LENGTH and len(self.packed) < KEPT:
            self.packed[stretch] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """All ids of a text, begin and end included, packed."""
        known, pack, vocab = self.packed.get, self.pack, self.vocabulary
        body = b"".join([known(s) or pack(s) for s in self.stretches(normalized(text))])
        return vocab.little[vocab.begin] + body + vocab.little[vocab.end]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process: its stretches and pairs serve all the tasks that run there."""
    return Encoder(path)


class Decoder:
    """Packed ids to texts."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)

    def decode(self, packed: bytes) -> str:
        """The text that the ids say, without the space that encoding put before it.

        Neighbouring byte pieces are read together; those that are no UTF-8 say U+FFFD each.
        """
        ids = memoryview(packed).cast("I").tolist()
        says, is_byte, silent = self.vocabulary.says, self.vocabulary.is_byte, self.vocabulary.silent
        inner = ids[1:-1] if len(ids) > 1 and ids[0] in silent and ids[-1] in silent else ids
        if not silent.isdisjoint(inner):  # what stands between silent ids is read by itself
            runs: list[list[int]] = [[]]
            for i in inner:
                runs.append([]) if i in silent else runs[-1].append(i)
        else:
            runs = [inner]
        said = [_read(b"".join([says[i] for i in run])) for run in runs]
        first = next((run[0] for run in runs if run), None)
        lead = first is not None and first not in is_byte and first != self.vocabulary.unknown and says[first].startswith(b" ")
        return "".join(said)[1 if lead else 0 :]


def _read(said: bytes) -> str:
    try:
        return said.decode()
    except UnicodeDecodeError:
        return said.decode(errors="broken_pieces")


def _broken(error: UnicodeDecodeError) -> tuple[str, int]:
    """U+FFFD for one byte, then on with the next."""
    return "�", error.start + 1


def _registered() -> None:
    import codecs

    codecs.register_error("broken_pieces", _broken)


def _per_batch(make, work: str, column: str, out: str, kind: pa.DataType, keep: bool):
    """An Arrow function that adds ``out``, made of ``column`` by method ``work`` of the object that ``make`` gives.

    Results are sent in parts of about ``SENT_BYTES``, so a batch of long texts is not held twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _registered()
        call = getattr(make(), work)
        for batch in batches:
            values, rest = batch.column(column), batch if keep else batch.drop_columns([column])
            made, sent, held = [], 0, 0
            for row in range(batch.num_rows):
                made.append(call(values[row].as_py() or _NOTHING[kind]))
                held += len(made[-1])
                if held >= SENT_BYTES or row + 1 == batch.num_rows:
                    part = rest.slice(sent, len(made))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, kind)], [*part.schema.names, out])
                    made, sent, held = [], row + 1, 0

    return run


#: What a null reads as, by what is made of it.
_NOTHING = {pa.binary(): "", pa.string(): b""}


def _schema(df: DataFrame, dropped: str | None, out: str, kind: str):
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != dropped]).withColumn(out, F.lit(None).cast(kind)).schema


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, keep: bool = True) -> DataFrame:
    """``docs``, without the text unless ``keep``, with ``out``: the text's ids, begin and end included, as packed little-endian unsigned 32-bit integers."""
    path = path or model_path()
    return docs.mapInArrow(_per_batch(lambda: encoder(path), "encode", text, out, pa.binary(), keep), _schema(docs, None if keep else text, out, "binary"))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, keep: bool = True) -> DataFrame:
    """``rows``, without the ids unless ``keep``, with ``out``: the text that packed ids say."""
    path = path or model_path()
    return rows.mapInArrow(_per_batch(lambda: Decoder(path), "decode", ids, out, pa.string(), keep), _schema(rows, None if keep else ids, out, "string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    said = decode(encode(docs, keep=False))
    n_tokens = F.call_function("div", F.octet_length("ids"), F.lit(4)).cast("long")
    return said.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
