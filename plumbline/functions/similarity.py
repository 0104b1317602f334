"""Similarities of texts and vectors."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _words(text: str) -> list[str]:
    return sorted(set(text.lower().split()))


def token_set_ratio(a: str | None, b: str | None) -> float:
    """0 to 100: the best of comparing the shared words with each side's words and the sides with each other."""
    x, y = set(_words(a or "")), set(_words(b or ""))
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    left, right = (" ".join([shared, *sorted(side)]).strip() for side in (x - y, y - x))
    if shared and (not x - y or not y - x):
        return 100.0
    pairs = [(left, right), *([(shared, left), (shared, right)] if shared else [])]
    return 100 * max(SequenceMatcher(None, p, q).ratio() for p, q in pairs)


def _longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence: no fewer characters than difflib matches."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = rest = (1 << len(a)) - 1
    for c in b:
        hit = rest & at.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return len(a) - rest.bit_count()


def _may_reach(x: list[str], y: list[str], threshold: float) -> bool:
    """Can token_set_ratio of two texts, as by _words and with something of their own each, be as large as the threshold?"""
    shared = set(x) & set(y)
    first = sorted(shared)
    left, right = (" ".join([*first, *(w for w in side if w not in shared)]) for side in (x, y))
    head = len(" ".join(first))
    if head and 200 * head >= threshold * (head + min(len(left), len(right))):
        return True
    return 200 * _longest_common(left, right) >= threshold * (len(left) + len(right)) - 1e-6


def first_leaders(texts: list[str], threshold: float) -> list[int]:
    """Position of the leader of each of some distinct texts: the first leader with token_set_ratio >= threshold, else itself.

    A pair is compared only if the characters both have, or the words they share, allow the ratio; nothing is lost.
    """
    words = [_words(t) for t in texts]
    plain = [" ".join(w) for w in words]
    letters = {c: i for i, c in enumerate(sorted(set("".join(plain))))}
    counts = np.zeros((len(texts), len(letters)), dtype=np.int16)
    for i, t in enumerate(plain):
        for c in t:
            counts[i, letters[c]] += 1
    size = np.array([len(t) for t in plain], dtype=np.int64)
    holders: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for x in w:
            holders.setdefault(x, []).append(i)
    held = {w: np.array(h) for w, h in holders.items()}
    leaders = np.empty(len(texts), dtype=np.int64)
    n, chosen = 0, []
    for i, text in enumerate(texts):
        head = np.zeros(len(texts))
        for w in words[i]:
            head[held[w]] += len(w) + 1
        lead = leaders[:n]
        head = np.maximum(head[lead] - 1, 0)
        both = np.minimum(counts[lead], counts[i]).sum(1, dtype=np.int64)
        close = 200 * both >= threshold * (size[lead] + size[i]) - 1e-6
        close |= (head > 0) & (200 * head >= threshold * (head + np.minimum(size[lead], size[i])) - 1e-6)
        found = next((int(k) for k in lead[close] if _may_reach(words[k], words[i], threshold) and token_set_ratio(texts[k], text) >= threshold), None)
        if found is None:
            leaders[n] = found = i
            n += 1
        chosen.append(found)
    return chosen


@F.pandas_udf(T.DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts; 0 if either is null or empty."""
    for left, right in batches:
        yield pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def word_set_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([token_set_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
