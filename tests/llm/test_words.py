"""Spelling variants, SentencePiece encoding and collocations against brute force, the library and plain counts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cadenza.llm import collocations, sentencepieces, spelling

DOCS = "doc_id long, text string, lang string, source string, ids string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, text, lang, "x", "clash") for i, text, lang in rows], DOCS)


# Spelling variants


def one_edit(word: str, alphabet: str) -> set[str]:
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in alphabet:
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)} | {word[:i] + c + word[i + 1 :] for i in range(len(word))}
    return out - {word}


def plain_variants(rows, min_length=7, min_count=2, ratio=10):
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    alphabet = "".join(sorted({c for w in counts for c in w}))
    forms, near = {}, {}
    for w in counts:
        near[w] = [x for x in one_edit(w, alphabet) if x in counts]
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            forms[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(near[w]), counts.get(forms.get(w))))
    return out


def spelled(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def misspelt(seed: int, size: int):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abéÿ") for _ in range(rnd.randint(7, 9))) for _ in range(12)]
    rows = []
    for i in range(size):
        some = []
        for _ in range(40):
            w = rnd.choice(base[: 1 + int(12 * rnd.random() ** 3)])
            if rnd.random() < 0.1:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abZ") + w[k:], w[:k] + "B" + w[k + 1 :]])
            some.append(w)
        rows.append((i, rnd.choice([" ", "1", "\n", "×x"]).join(some), "en"))
    return rows


@pytest.mark.parametrize("room", [1, 1 << 20])
def test_variants_against_every_edit(spark, room):
    """The same result with all shards in one pass and with a shard a pass; nulls, repeats and ids that are absent."""
    rows = [*misspelt(1, 60), (None, "abababa abababa", None), (5, None, "en"), (6, "", "en"), (7, "abababa", "en"), (7, "abababa", "en")]
    got = spelled(spelling.variants(docs(spark, rows), max_broadcast_bytes=room, shard_words=50))
    assert got == plain_variants(rows)
    assert any(form != root and form for _, form, root, *_ in got) or any(form for _, form, *_ in got)


def test_chains_of_forms_reach_their_root(spark):
    rows = [(i, text, "en") for i, text in enumerate(["abcdefgh " * 2, "abcdefg " * 21, "abcdefgx " * 3, "abcdefgxy " * 400, "bbcdefg " * 250])]
    got = {w: (form, root) for w, form, root, *_ in spelled(spelling.variants(docs(spark, rows), ratio=2, drop_every=1 << 33))}
    assert got["abcdefgh"] == ("abcdefg", "bbcdefg") and got["abcdefgx"] == ("abcdefgxy", "abcdefgxy") and got["bbcdefg"] == (None, "bbcdefg")


def test_very_long_words_and_empty_tables(spark):
    long_ = "abcdefghij" * 20_000
    rows = [(1, f"{long_} {long_}", "en"), (2, f"{long_}k {long_}k", "en")]
    got = {len(w): near for w, _, _, _, near, _ in spelled(spelling.variants(docs(spark, rows), drop_every=1 << 33))}
    assert got == {200_000: 1, 200_001: 1}
    assert spelled(spelling.variants(docs(spark, []))) == set()


def test_tries_against_every_edit():
    rnd = random.Random(5)
    for _ in range(60):
        letters = rnd.choice(["ab", "abc", "abcdefgh", "aéÿ"])
        made = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8)))  # noqa: B023, E731
        words = sorted({made() for _ in range(rnd.randint(1, 90))})
        trie = spelling.Trie(*spelling.packed_trie(words, [1] * len(words)))
        for word in [*words, *(made() for _ in range(20))]:
            assert {words[x] for x in trie.near(word)} == one_edit(word, letters) & set(words)


# SentencePiece


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=sentencepieces.model_path())


def texts():
    rnd = random.Random(3)
    alphabets = ["abcde ", "aab ", "the an in ing  ", "日本語の漢字。、", "\n\t a▁\x00\x01é", "=-_/.,;:(){}<>0123456789 ", "\U0001f642\U0001f643 a‍", "АБВабв ", "▁ "]
    vocabulary = list(sentencepieces.vocabulary(sentencepieces.model_path()).ids)
    out = ["", " ", "<s></s><unk><0x41>", "x" * 5000, "日本" * 4000, " " * 3000, "thein" * 3000]
    for _ in range(3000):
        kind = rnd.random()
        if kind < 0.4:
            out.append("".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randint(0, 40))))
        elif kind < 0.7:
            letters = rnd.choice(alphabets)
            out.append("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))))
        else:
            out.append("".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))))
    return out


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_encoding_and_decoding_as_the_library_does(spark, library):
    rows = [(i, text, "en") for i, text in enumerate(texts())] + [(-1, None, None)]
    got = sentencepieces.decode(sentencepieces.encode(docs(spark, rows), out="made"), "made").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert bytes(r["made"]) == packed(ids) and r["decoded"] == library.decode(ids) and r["ids"] == "clash"


def test_decoding_any_ids(library):
    rnd, decoder = random.Random(4), sentencepieces.Decoder(sentencepieces.model_path())
    sentencepieces._registered()
    for _ in range(5000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3)]) for _ in range(rnd.randint(0, 8))]
        assert decoder.decode(packed(ids)) == library.decode(ids), ids


def test_long_text_without_a_cut_takes_linear_time():
    import time

    encoder, took = sentencepieces.Encoder(sentencepieces.model_path()), []
    for size in (20_000, 200_000):
        began = time.process_time()
        encoder.backtracked("ab" * size)
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.01)


def test_an_empty_table_encodes_to_nothing(spark):
    assert sentencepieces.decode(sentencepieces.encode(docs(spark, []), out="made"), "made").count() == 0


# Collocations


def plain_collocations(rows, max_n, min_count, percent, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, max_n + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        for p, a in candidates.items():
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            longer = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * candidates[q] >= percent * a for q in longer):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def collocated(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("max_n", "top"), [(3, 2000), (4, 5)])
def test_collocations_against_plain_counts(spark, max_n, top):
    rnd = random.Random(2)
    words = ["New", "york", "city", "é", "\U0001f642", "x y", "the", "of"]
    rows = []
    for i in range(60):
        text = "".join(rnd.choice(words[: 2 + int(7 * rnd.random() ** 2)]) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for _ in range(50))
        rows.append((i, text, rnd.choice(["en", "de", None, "und"])))
    rows += [(1, None, "en"), (2, "", "fr"), (3, " .. \t", "es"), *[(4, "alone again alone again", "pt")] * 12]
    got = collocated(collocations.collocations(docs(spark, rows), max_n=max_n, top=top))
    assert got == plain_collocations(rows, max_n, 10, 50, top) and any(len(r[2].split()) > 2 for r in got)


def test_scores_beyond_64_bits(spark):
    """Counts of 1e12: their products pass 64 bits and stay exact."""
    a = 999_999_999_989
    counts = spark.createDataFrame([("en", 0, "", 9), ("en", 1, "p", 1_000_000_000_000), ("en", 1, "q", 999_999_999_999), ("en", 2, "p q", a)], "lang string, size int, phrase string, f long")
    assert [r["score"] for r in collocations.weakest_cuts(counts).collect()] == [1_000_000 * a * a // (1_000_000_000_000 * 999_999_999_999)]


def test_no_documents_no_phrases(spark):
    assert collocated(collocations.collocations(docs(spark, []))) == []
