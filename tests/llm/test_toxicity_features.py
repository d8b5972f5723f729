"""The features of a text against counting them token by token."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest

from cadenza.llm import toxicity as X

LEXICON = {"grum-": 1.5, "grumble": 2.5, "vexing": 2.0, "loser": 0.7}


def plain_features(text):
    tokens = (text or "").split()
    n = max(1, len(tokens))
    weights, fixed, you, masked = [], [], [], []
    for t in tokens:
        word, hidden = X.plain(t)
        found = [LEXICON.get(word, 0.0)] + [LEXICON.get(word[:k] + "-", 0.0) for k in X.STEMS if len(word) > k]
        weights.append(max(found))
        fixed.append(word in X.INSULTS)
        you.append(word in X.YOU)
        masked.append(hidden)
    hit = [bool(w) or f for w, f in zip(weights, fixed, strict=True)]
    # A hit is near if a pronoun stands at most four tokens from it: behind the last one before it, or before the next.
    near = 0
    for i, h in enumerate(hit):
        if h and not you[i]:
            before = [i - j for j in range(i) if you[j]]
            after = [j - i for j in range(i + 1, len(tokens)) if you[j]]
            near += bool(before and min(before) <= 4) or bool(after and min(after) <= 4)
    return [
        sum(hit), sum(hit) / n, max([w for w, h in zip(weights, hit, strict=True) if h], default=0.0), sum(w for w, h in zip(weights, hit, strict=True) if h) / n, sum(fixed) / n, near / n, sum(you) / n,
        sum(t.isupper() and len(t) > 1 for t in tokens) / n, sum(c.isupper() for t in tokens for c in t) / max(1, len(text or "")), (text or "").count("!") / n,
        sum(c in "!?*#$%&@" for c in text or "") / n, sum(masked) / n, len(re.findall(r"(?<!\S)\w(?:[ .\-*]\w){2,}(?!\S)", text or "")) / n, len(re.findall(r"(\w)\1\1", text or "")) / n, math.log1p(len(tokens)),
    ]


@pytest.mark.parametrize("seed", range(40))
def test_features_equal_a_plain_count(seed):
    rng = np.random.default_rng(seed)
    pool = ["you", "grumbling", "vexing", "l0s3r!!", "idiot", "calm", "WORDS", "a", "b", "c", "soooo", "u", "St0p", "été", "deine", "—", "w*a*y", "2024", "grumble!"]
    text = " ".join(rng.choice(pool, rng.integers(0, 60)))
    assert X.features(text, LEXICON, {}) == pytest.approx(plain_features(text))


def test_features_of_nothing_and_of_a_very_long_text():
    assert X.features(None, LEXICON, {}) == X.features("", LEXICON, {}) == [0.0] * len(X.FEATURES)
    long = "you idiot " * 100_000
    assert X.features(long, LEXICON, {}) == pytest.approx(plain_features_of_pairs(100_000))


def plain_features_of_pairs(k):
    n = 2 * k
    return [k, 0.5, 0.0, 0.0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, math.log1p(n)]
