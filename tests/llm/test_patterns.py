"""Patterns of words and codes against plain counts, also for long repeated sentences."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

pytest.importorskip("plumbline.llm")
from plumbline.llm import subjects  # noqa: E402


def test_patterns_are_those_of_plain_counts():
    rng = random.Random(1)
    rows = [(tuple(sorted(rng.sample(range(12), rng.randint(1, 7)))), tuple(rng.sample("ab", rng.randint(0, 2))), rng.randint(1, 2)) for _ in range(80)]
    expected = {}
    for size in range(1, subjects.RULE_WORDS + 1):
        for chosen in combinations(range(12), size):
            held = [r for r in rows if set(chosen) <= set(r[0])]
            codes = Counter()
            for _, cs, n in held:
                codes.update({c: n for c in cs})
            if sum(n for _, _, n in held) >= 4:
                expected[chosen] = (sum(n for _, _, n in held), dict(codes))
    assert {tuple(sorted(f)): (n, dict(c)) for f, n, c in subjects.grow(rows, 4)} == expected and len(expected) > 100


def test_long_repeated_sentences_end(spark):
    words = [f"{a}{b}term" for a in "abcdefgh" for b in "klmno"]
    long = "The " + " ".join(words) + "."
    docs = [(i, f"{long} Paint the wall again.") for i in range(50)] + [(100 + i, f"Nothing of that kind here, item number {i}. Other words stand in this line.") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "x") for i in range(50)] + [(100 + i, "y") for i in range(50)], "doc_id bigint, subject string")
    found = {(r.doc_id, r.subject) for r in subjects.subject_areas(df, "doc_id", "text", labels).collect()}
    assert {(i, "x") for i in range(50)} <= found and not {(i, "y") for i in range(50)} & found
