"""PII: weak supervision.

Spans that may be personal data are those of the strict base patterns, what is left of a base run that fails
as a whole (a telephone number with an address behind it, two card numbers in a row), and what a person would
read as such data in another spelling.  Six labelers (a pattern, a check, words around, a gazetteer, the
boundary and the form) vote on each: yes, no or nothing.

Expectation maximisation on the counts of vote patterns over the whole corpus estimates each labeler's
reliability and every pattern's probability of being personal data.  With these probabilities as soft labels
a logistic regression is trained on what the labelers do not see: the span's shape, the characters at its
edges and the words near it, hashed to ``DIM`` features.  It decides which spans are added (``ACCEPT``).  Base
spans always stay.

One pass over the texts finds spans, votes and features; texts are not read again or shuffled.  What reaches
the driver is one count per vote and length pattern, of which there are at most ``4 * 3 ** 6 * 12``, and the
classifier's weights.  The classifier is fitted on at most about ``MAX_TRAIN`` spans, drawn by a hash for each
kind and, apart, for base and other spans, with weights that restore their shares.

Limits of the spellings beyond the base: local parts up to 64 characters, domains of up to five labels.

Edge cases: null and empty texts have no spans; repeated rows are reported once per row and counted once
per row; very long runs without a match cost linear time; extra columns are ignored; with no spans but base
ones nothing is added.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "validity", "context", "gazetteer", "boundary", "pattern")
ACCEPT = 0.9
DIM = 2048
MAX_TRAIN = 20_000
_WINDOW = 40

# Base patterns, as (from anywhere, from just behind a match).  A run that fails from its start fails
# from its middle too, so starts inside runs are skipped; groups are possessive: no quadratic search.
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]++@", r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_BASE = {
    "email": (re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}{_DOMAIN}"), re.compile(_LOCAL + _DOMAIN)),
    "ip": (re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), re.compile(r"[0-9]++(?:\.[0-9]++){3}")),
    "card": (re.compile(r"[0-9](?:[\x20-]?[0-9])++"),) * 2,
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),) * 2,
}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}

# Spellings that a person would read as such data although the strict pattern doesn't.
_SIGN, _DOT = r"(?: ?(?:\(at\)|\[at\]|\{at\}|＠) ?| @ )", r" ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_WIDE = {
    "email": re.compile(rf"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}(?:{_SIGN}{_LABEL}(?:{_DOT}{_LABEL}){{1,4}}| at {_LABEL}(?: dot {_LABEL}){{1,4}})(?![\w-])", re.IGNORECASE),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![\w+.-])(?:00[0-9]{1,3}[ .-]?|\(0?[0-9]{2,4}\) ?|0)[0-9](?:[ ./()-]{0,2}[0-9]){6,13}(?![\w-])"),
}
#: What may stand inside a base run that fails as a whole.
_CARD_INSIDE = re.compile(r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])")
_GROUP_END = re.compile(r"[0-9](?=[^0-9]|$)")
#: What a text must hold for any of the wide spellings; " at " alone, which most texts hold, needs a " dot " behind it.
_MAY = {"email": re.compile(r"[\[({]at[\])}]|＠| @ | dot ", re.IGNORECASE), "ip": re.compile(r"[0-9](?:\[\.\]|\(\.\)| \. )[0-9]"), "card": re.compile(r"[0-9]{4}[ ./_-]{1,2}[0-9]{4}"), "phone": re.compile(r"\(0?[0-9]{2,4}\)|(?<![0-9])0[0-9]")}

#: Words that speak for a kind, words that speak against any, and gazetteers.
_FOR = {
    "email": re.compile(r"e-?mail|contact|write|reach|mailto|correo|adresse|courriel|kontakt", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address|client|login|adresse|from", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|debit|amex|maestro|karte|carte|tarjeta|payment", re.IGNORECASE),
    "phone": re.compile(r"phone|\btel\b|call|mobile|\bfax\b|telefon|téléphone|teléfono|móvil|handy|dial", re.IGNORECASE),
}
_AGAINST = re.compile(r"isbn|issn|invoice|order no|version|\bv\.?$|serial|token|hash|build|\bdoi\b|§|page|total|\bsku\b", re.IGNORECASE)
_DOMAINS = re.compile(r"(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca|mx|br)$", re.IGNORECASE)
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|62|35")
_CALLING = re.compile(r"(?:00|\+)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-9:].lstrip("0") or 0) <= 255 for p in re.findall("[0-9]+", text))


def valid(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return _octets(text)
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_runs(kind: str, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(spans, failed): leftmost non-overlapping matches of a base pattern that pass its check, and the others."""
    if kind in _NEEDS and _NEEDS[kind] not in text:
        return [], []
    anywhere, behind = _BASE[kind]
    spans, failed, at = [], [], 0
    while found := (behind.match(text, at) if at else None) or anywhere.search(text, at):
        at = found.end()
        (spans if valid(kind, found[0]) else failed).append(found.span())
    return spans, failed


class _Spans:
    """Disjoint spans in order, to be asked for those that meet a stretch: two bisections, however many there are."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def meet(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end

    def next_start(self, start: int, end: int) -> int:
        """The first start behind ``start``, at most ``end``."""
        at = bisect.bisect_right(self.starts, start)
        return min(end, self.starts[at]) if at < len(self.starts) else end


def _inside(kind: str, text: str, start: int, end: int, others: list[_Spans]) -> list[tuple[int, int]]:
    """Spans inside a failed run; ``others`` are the base spans of each other kind."""
    if kind == "card":
        return [m.span() for m in _CARD_INSIDE.finditer(text, start, end) if valid(kind, m[0]) and not any(o.meet(*m.span()) for o in others)]
    if kind == "phone":
        # A number ends where something else begins, or else with the last group that it can hold.
        upto = min(o.next_start(start, end) for o in others)
        ends = [m.end() for m in _GROUP_END.finditer(text, start, min(upto, start + 40))]
        fits = [e for e in ends if 9 <= len(_digits(text[start:e])) <= 15]
        return [(start, fits[-1])] if fits else []
    return []


def _strict(kind: str, span: str) -> bool:
    """Whether a span, standing alone, is one of the base pattern."""
    found = _BASE[kind][0].fullmatch(span)
    return bool(found) and valid(kind, span)


def _votes(kind: str, text: str, start: int, end: int) -> list[int]:
    """One vote per labeler: 0 nothing, 1 yes, 2 no."""
    span, before, after = text[start:end], text[max(0, start - _WINDOW) : start], text[end : end + 12]
    digits = _digits(span)
    if kind == "email":
        fits = bool(re.search(r"[@＠\[({]| dot ", span))
    elif kind == "phone":
        fits = 9 <= len(digits) <= 15
    else:
        fits = valid(kind, digits if kind == "card" else span)
    known = {"email": _DOMAINS.search(span), "ip": not span.startswith(("0.", "255.")), "card": _ISSUERS.match(digits), "phone": _CALLING.match(digits)}[kind]
    inside = before[-1:].isalnum() or after[:1].isalnum() or before[-1:] in ("_", "#", "=", "/") or after[:1] in ("_", "=", "/")
    # Few digits in many places, a plain sequence, or bare digits for a telephone number look like something else.
    dull = len(set(digits)) <= 2 or digits in "01234567890123456789" or (kind == "phone" and span.isdigit())
    return [
        1 if _strict(kind, span) else 0,
        1 if fits else 2,
        1 if _FOR[kind].search(before) else 2 if _AGAINST.search(before) else 0,
        1 if known else 2,
        2 if inside else 1,
        2 if dull and kind != "email" else 1 if (kind == "email" and not re.search(" at ", span)) or re.search(r"[ ().-]", span) else 0,
    ]


def _code(kind: str, votes: list[int], length: int, strict: bool) -> int:
    """Votes and shape in one number."""
    code = KINDS.index(kind)
    for v in votes:
        code = code * 3 + v
    return (code * 6 + min(5, length // 5)) * 2 + strict


def _decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes, length class) of codes."""
    rest, shape = codes // 2 // 6, codes // 2 % 6
    votes = np.empty((len(codes), len(LABELERS)), int)
    for i in reversed(range(len(LABELERS))):
        votes[:, i], rest = rest % 3, rest // 3
    return rest, votes, shape


def _shape(span: str) -> str:
    """Digits as 9, letters as a, runs of letters as one."""
    return re.sub("a+", "a", re.sub("[^\\W\\d_]", "a", re.sub("[0-9]", "9", span)))[:32]


def _edge(c: str) -> str:
    return "none" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "blank" if c.isspace() else c


def _features(kind: str, text: str, start: int, end: int) -> list[int]:
    """What the labelers do not look at, as hashed places below ``DIM``."""
    span, plain = text[start:end], lambda w: re.sub("[0-9]", "9", w.strip(".,;:!?()[]{}\"'").lower())[:16]
    before, after = text[max(0, start - 60) : start].split()[-3:], text[end : end + 60].split()[:3]
    said = [f"shape {_shape(span)}", f"left {_edge(text[start - 1 : start])}", f"right {_edge(text[end : end + 1])}", f"length {min(8, len(span) // 4)}"]
    said += [f"digits {10 * len(_digits(span)) // len(span)}", f"kinds {len(set(_digits(span)))}", f"signs {''.join(sorted(set(c for c in span if not c.isalnum())))}"]
    said += [f"near {plain(w)}" for w in before + after] + [f"before {plain(w)}" for w in before[-1:]] + [f"after {plain(w)}" for w in after[:1]]
    return sorted({zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % DIM for x in ["any", *said]})


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, code) of base spans and others, by start and kind; odd codes are base."""
    runs = {kind: base_runs(kind, text) for kind in KINDS}
    bases = {kind: _Spans(base) for kind, (base, _) in runs.items()}
    out = []
    for kind, (base, failed) in runs.items():
        out += [(kind, s, e, _code(kind, _votes(kind, text, s, e), e - s, True)) for s, e in base]
        # Runs of a kind are disjoint, so what is found inside failed ones meets neither a base span nor each other.
        others = [spans for k, spans in bases.items() if k != kind]
        inside = [x for s, e in failed for x in _inside(kind, text, s, e, others)]
        taken = _Spans(list(heapq.merge(base, inside)))
        wide = [m.span() for m in _WIDE[kind].finditer(text)] if _MAY[kind].search(text) else []
        more = inside + [x for x in wide if not taken.meet(*x)]
        out += [(kind, s, e, _code(kind, _votes(kind, text, s, e), e - s, False)) for s, e in more]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


_SPAN = T.StructType().add("name", "string").add("code", "integer").add("x", T.ArrayType(T.IntegerType()))
_FOUND = T.StructType().add("n_email", "long").add("n_ip", "long").add("n_card", "long").add("n_phone", "long").add("base_sha256", "string")
_FOUND = _FOUND.add("found", T.ArrayType(_SPAN))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.list_(pa.struct([("name", pa.string()), ("code", pa.int32()), ("x", pa.list_(pa.int32()))]))
    for batch in batches:
        counts, hashes, found = [[] for _ in KINDS], [], []
        for text in batch.column("text"):
            text = text.as_py()
            spans = candidates(text) if text else []
            base = [s for s in spans if s[3] & 1]
            for kind, n in zip(KINDS, counts, strict=True):
                n.append(sum(s[0] == kind for s in base))
            hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
            found.append([{"name": joined([s]), "code": s[3], "x": _features(s[0], text, s[1], s[2])} for s in spans])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(hashes), pa.array(found, item)], ["doc_id", *_FOUND.names])


def estimate(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each pattern, reliability[labeler, truth, vote]) by expectation maximisation."""
    yes, no = (votes == 1).sum(1), (votes == 2).sum(1)
    p = 1 / (1 + np.exp(-1.5 * (yes - no) + 0.5))
    reliability = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        log_odds = np.zeros(len(p))
        for k in range(len(KINDS)):
            own = kind == k
            share = (np.sum((p * n)[own]) + 1) / (np.sum(n[own]) + 2)
            log_odds[own] = np.log(share / (1 - share))
        for i in range(votes.shape[1]):
            for v in range(3):
                has = votes[:, i] == v
                # A labeler is held to be better than chance: a prior of ten matching votes.
                prior = np.array([[1, 1, 11], [1, 11, 1]])
                for y, q in enumerate((1 - p, p)):
                    reliability[i, y, v] = (np.sum((q * n)[has]) + prior[y, v]) / (np.sum(q * n) + prior[y].sum())
            log_odds += np.log(reliability[i, 1, votes[:, i]] / reliability[i, 0, votes[:, i]])
        p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return p, reliability


def probabilities(counts: list[tuple[int, int]]) -> dict[int, float]:
    """Each code's probability of being personal data, from how often each was seen."""
    codes, n = (np.array(x, np.int64) for x in zip(*counts, strict=True))
    kind, votes, _ = _decode(codes)
    p, _ = estimate(kind, votes, n)
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


def train_classifier(spans: DataFrame, counts: list[tuple[int, int]], max_train: int = MAX_TRAIN, ridge: float = 1e-3) -> tuple[float, list[float]]:
    """(intercept, weights): logistic regression on soft labels of spans (code, x, pick), pick a hash from 0 to 999,999."""
    steps = 1_000_000
    group = lambda code: 2 * (code // (12 * 3 ** len(LABELERS))) + code % 2
    sizes: dict[int, int] = {}
    for code, n in counts:
        sizes[group(code)] = sizes.get(group(code), 0) + n
    share = {g: max(1, min(steps, steps * max_train // (len(sizes) * n))) for g, n in sizes.items()}
    facts = [(code, float(p), int(share[group(code)])) for code, p in probabilities(counts).items()]
    told = spans.sparkSession.createDataFrame(facts, "f_code int, p double, share int")
    drawn = spans.join(F.broadcast(told), F.col("code") == F.col("f_code")).where(F.col("pick") < F.col("share"))
    weight = F.lit(float(steps)) / F.col("share")
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (weight * F.col("p")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (weight * (1 - F.col("p"))).alias("weight"))))
    rows = drawn.select(F.col("x").cast("array<string>").alias("x"), both.alias("t")).select("x", "t.label", "t.weight")
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(DIM)], inputCol="x", outputCol="features")
    # The sample is bounded, so a few partitions hold it.
    fitted = LogisticRegression(weightCol="weight", regParam=ridge, maxIter=40).fit(vectors.transform(materialize(rows.coalesce(4), "pii-train")))
    return float(fitted.intercept), fitted.coefficients.toArray().tolist()


def find(docs: DataFrame, accept: float = ACCEPT, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per document row: doc_id, counts of base spans, base_sha256 and spans (base and added)."""
    rows = docs.select("doc_id", "text")
    found = materialize(rows.mapInArrow(_finder, T.StructType([rows.schema["doc_id"], *_FOUND])), "pii-found")
    spans = found.select("doc_id", F.explode("found").alias("s")).select("s.code", "s.x", F.pmod(F.xxhash64("doc_id", "s.name"), F.lit(1_000_000)).alias("pick"))
    # One row per vote and length pattern: bounded, whatever the corpus.
    counts = [(r["code"], r["n"]) for r in spans.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()]
    is_base = lambda s: s["code"] % 2 == 1
    if any(code % 2 == 0 for code, _ in counts):
        intercept, weights = train_classifier(spans, counts, max_train)
        learnt = F.array(*map(F.lit, weights))
        score = lambda s: F.aggregate(s["x"], F.lit(intercept), lambda acc, i: acc + F.get(learnt, i))
        kept = F.filter("found", lambda s: is_base(s) | (score(s) >= math.log(accept / (1 - accept))))
    else:
        kept = F.filter("found", is_base)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(F.transform(kept, lambda s: s["name"]), ",").alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
