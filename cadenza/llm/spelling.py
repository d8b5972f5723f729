"""Spelling variants: every word's distance-one automaton meets compact tries of all words.

Words are counted by a plain aggregation, sorted by ranges, and cut into shards of at most ``SHARD_WORDS``
neighbours in order.  Each shard is a compact trie: arrays of edges, where a branch that leads to one word only
ends in that word.  Shards are broadcast, ``max_broadcast_bytes`` at a time (a larger vocabulary means more
passes, each over all words), and each word's Levenshtein automaton of one edit walks every shard depth-first.
Its states are the characters matched so far and whether the edit is spent; a branch ends where no state is
left.  Accepting words are reduced to a count and the best form in the task, and then over the passes.

Forms point to words of at least ``RATIO`` times the occurrences, so chains are short (the logarithm of the
largest count) and roots are found by doubling pointers.

Edge cases: null and empty texts have no words; a null doc_id reads as an empty string; repeated rows count once
per row; runs of any length are whole words (a word of a million characters is one walk along its own branch);
words without near ones have n_near 0, no form and themselves as root; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import ascii_lower, materialize, table

MIN_LENGTH, MIN_COUNT, RATIO, DROP_EVERY = 7, 2, 10, 31
SHARD_WORDS, SHARD_BYTES, WORDS_A_TASK = 200_000, 4 << 20, 20_000
MAX_BROADCAST_BYTES = 32 << 20
_SHARD = "bytes long, words binary, counts binary, first binary, labels binary, targets binary, ends binary"
_PARTS = ["words", "counts", "first", "labels", "targets", "ends"]


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): the distinct words of at least ``min_length`` code points and ``min_count`` occurrences.

    A run whose document and text hash to a multiple of ``drop_every`` loses the code point that the hash names.
    """
    # Shorter runs can only become shorter, and a run matches from its first letter on or not at all.
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(rf"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    spot = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % drop_every == 0, F.concat(F.substring("run", F.lit(1), spot), F.substr("run", spot + 2))).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


class Trie:
    """A shard's words, sorted, and the edges that lead to them.

    Node ``k`` has the edges ``first[k]`` up to ``first[k + 1]``, sorted by ``labels``.  A target is a node or, below 0,
    the complement of the only word behind the edge.  ``ends[k]`` is the word that ends at node ``k``, or -1.
    """

    def __init__(self, words: bytes, counts: bytes, first: bytes, labels: bytes, targets: bytes, ends: bytes):
        self.words = words.decode().split("\n")
        self.counts, self.first, self.labels, self.targets, self.ends = (array(kind, part) for kind, part in zip("qiiii", (counts, first, labels, targets, ends), strict=True))
        # What may follow a node, as one bit per letter modulo 64: most edges beside a word are left at once by it.
        bits = [1 << (label & 63) for label in self.labels]
        self.follows = array("Q", bytes(8 * len(self.ends)))
        for node, start in enumerate(self.first[:-1]):
            all_ = 0
            for bit in bits[start : self.first[node + 1]]:
                all_ |= bit
            self.follows[node] = all_
        # At the root nearly every letter goes on, so what is behind each first letter is found by the three letters
        # after it; words that branch off alone before that are found by all that follows their first letter.
        self.deep: dict[str, list[tuple[int, int]]] = {}
        self.early: dict[str, list[int]] = {}
        open_ = [(0, "", 0)]
        while open_:
            node, path, lead = open_.pop()
            if len(path) == 4:
                self.deep.setdefault(path[1:], []).append((lead, node))
                continue
            if self.ends[node] >= 0:
                self.early.setdefault(path[1:], []).append(self.ends[node])
            for edge in range(self.first[node], self.first[node + 1]):
                label, target = self.labels[edge], self.targets[edge]
                if target < 0:
                    self.early.setdefault(self.words[~target][1:], []).append(~target)
                else:
                    open_.append((target, path + chr(label), lead or label))

    def exact(self, node: int, word: str, at: int, shift: int) -> int:
        """The word that reads ``word[at:]`` below a node of depth ``at + shift``, or -1: the automaton whose edit is spent."""
        first, labels, targets = self.first, self.labels, self.targets
        for at in range(at, len(word)):
            end, label = first[node + 1], ord(word[at])
            edge = bisect_left(labels, label, first[node], end)
            if edge == end or labels[edge] != label:
                return -1
            node = targets[edge]
            if node < 0:
                only = self.words[~node]
                return ~node if len(only) == len(word) + shift and only[at + 1 + shift :] == word[at + 1 :] else -1
        return self.ends[node]

    def near(self, word: str) -> set[int]:
        """The words that differ from ``word`` by one inserted, deleted or replaced code point.

        The walk follows the word itself and, at each node, spends the edit on every edge beside it.  Of equal
        edits in a run of one letter the last one is taken.
        """
        words, first, labels, targets, follows, ends, exact, upto = self.words, self.first, self.labels, self.targets, self.follows, self.ends, self.exact, len(word)
        found, node = {-1}, 0
        bits = [1 << (ord(c) & 63) for c in word]
        for at in range(upto + 1):
            label = ord(word[at]) if at < upto else -1
            if at < upto and word[at + 1 : at + 2] != word[at]:
                found.add(exact(node, word, at + 1, -1))
            onward = None
            if at == 0 and upto > 4:
                for lead, target in self.deep.get(word[1:4], ()):
                    if lead != label:
                        found.add(exact(target, word, 4, 0))
                for lead, target in self.deep.get(word[:3], ()):
                    if lead != label:
                        found.add(exact(target, word, 3, 1))
                for rest in (word, word[1:]):
                    found.update(place for place in self.early.get(rest, ()) if words[place][0] != word[0])
                edge = bisect_left(labels, label, 0, first[1])
                if edge == first[1] or labels[edge] != label:
                    break
                onward = targets[edge]
            for edge in range(first[node], first[node + 1]) if onward is None else ():
                target = targets[edge]
                if labels[edge] == label:
                    onward = target
                elif target >= 0:
                    after = follows[target]
                    if at == upto:
                        found.add(ends[target])
                        continue
                    if after & bits[at]:
                        found.add(exact(target, word, at, 1))
                    if at + 1 == upto:
                        found.add(ends[target])
                    elif after & bits[at + 1]:
                        found.add(exact(target, word, at + 1, 0))
                else:
                    only = words[~target]
                    if (len(only) == upto + 1 and only[at + 1 :] == word[at:]) or (len(only) == upto and only[at + 1 :] == word[at + 1 :]):
                        found.add(~target)
            if onward is None:
                break
            if onward < 0:
                if one_apart(words[~onward], word, at + 1):
                    found.add(~onward)
                break
            node = onward
        found.discard(-1)
        return found


def one_apart(a: str, b: str, at: int = 0) -> bool:
    """Whether two texts that agree before ``at`` differ by one edit."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    while at < len(b) and a[at] == b[at]:
        at += 1
    return at < len(a) and a[at + 1 :] == b[at + (len(a) == len(b)) :]


def packed_trie(words: list[str], counts: list[int]) -> tuple[bytes, ...]:
    """The parts of a trie of sorted words, breadth-first."""
    first, labels, targets, ends = (array("i") for _ in range(4))
    nodes = [(0, len(words), 0)]
    for low, high, depth in nodes:
        first.append(len(labels))
        ended = len(words[low]) == depth
        ends.append(low if ended else -1)
        low += ended
        while low < high:
            label = words[low][depth]
            next_ = bisect_right(words, label, low + 1, high, key=lambda w: w[depth])  # noqa: B023
            labels.append(ord(label))
            targets.append(~low if next_ == low + 1 else len(nodes))
            if next_ > low + 1:
                nodes.append((low, next_, depth + 1))
            low = next_
    first.append(len(labels))
    return ("\n".join(words).encode(), *(part.tobytes() for part in (array("q", counts), first, labels, targets, ends)))


def shards(vocabulary: DataFrame, n_words: int, shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tries of at most ``shard_words`` words and about ``shard_bytes`` of text, in the order of the words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        counts: list[int] = []
        size = 0

        def made() -> pa.RecordBatch:
            parts = packed_trie(held, counts)
            held.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([sum(map(len, parts))], pa.int64()), *(pa.array([part], pa.binary()) for part in parts)], ["bytes", *_PARTS])

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                held.append(word)
                counts.append(n)
                size += len(word)
                if len(held) >= shard_words or size >= shard_bytes:
                    yield made()
                    size = 0
        if held:
            yield made()

    ranged = vocabulary.repartitionByRange(max(1, ceil(n_words / shard_words)), "word").sortWithinPartitions("word")
    return ranged.mapInArrow(build, _SHARD).withColumn("shard", F.monotonically_increasing_id())


#: The tries of the broadcast that this worker process read last.
_held: dict[str, list[Trie]] = {}


def _met(vocabulary: DataFrame, tries: DataFrame, n_words: int) -> DataFrame:
    """(word, n, n_near, best_n, best): each word and its neighbours among the given shards, which fit a broadcast."""
    key = uuid.uuid4().hex
    sent = vocabulary.sparkSession.sparkContext.broadcast([tuple(bytes(part) for part in row) for row in tries.select(*_PARTS).collect()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            _held.clear()
            _held[key] = [Trie(*parts) for parts in sent.value]
        tries = _held[key]
        for batch in batches:
            n_near, best_n, best = [], [], []
            for word in batch.column("word").to_pylist():
                hits = [(-trie.counts[x], trie.words[x]) for trie in tries for x in trie.near(word)]
                top = min(hits, default=(0, None))
                n_near.append(len(hits))
                best_n.append(-top[0])
                best.append(top[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())], [*batch.schema.names, "n_near", "best_n", "best"])

    dealt = vocabulary.select("word", "n").repartition(max(1, ceil(n_words / WORDS_A_TASK)), "word")
    return dealt.mapInArrow(meet, "word string, n long, n_near long, best_n long, best string")


def neighbours(vocabulary: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n) of a stored vocabulary: how many words are near, and the best of them, null if none."""
    n_words = vocabulary.count()
    tries = materialize(shards(vocabulary, n_words, shard_words), "tries")
    passes: list[list[int]] = []
    room = 0
    for shard in tries.select("shard", "bytes").orderBy("shard").toLocalIterator():  # two numbers a shard
        if not passes or shard["bytes"] > room:
            passes.append([])
            room = max_broadcast_bytes
        passes[-1].append(shard["shard"])
        room -= shard["bytes"]
    every = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    for some in passes:
        every = every.unionByName(_met(vocabulary, tries.where(F.col("shard").isin(some)), n_words))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("order"), "best")))
    found = every.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    return found.select("word", "n", "n_near", F.col("top.best").alias("form"), (-F.col("top.order")).alias("form_n"))


def variants(docs: DataFrame, ratio: int = RATIO, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, shard_words: int = SHARD_WORDS, **kw) -> DataFrame:
    """word, form, root, n, n_near, form_n.

    The form is the near word of most occurrences (ties: the smallest in code-point order), if it has at least
    ``ratio`` times the word's; the root is the last of the forms that follow each other.
    """
    if ratio < 2:
        raise ValueError(f"ratio: {ratio!r}")  # chains of forms must end
    vocabulary = materialize(words(docs, **kw), "words")
    near = neighbours(vocabulary, max_broadcast_bytes, shard_words)
    good = F.col("form_n") >= F.col("n") * ratio
    near = materialize(near.select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "near")
    most = near.agg(F.max("n")).first()[0] or 1
    links = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # Counts grow by the ratio from link to link, so `hops` links at most follow each other.
    hops, reach = int(log(most, ratio)) + 1, 1
    while reach < hops:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    rooted = near.join(links, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
