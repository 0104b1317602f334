"""Near-duplicates against brute force, also for long texts, ties, copies and other thresholds."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("plumbline.llm")
from plumbline.llm import neardup as N  # noqa: E402


def brute(rows, similarity, least):
    sets = [(i, set(re.findall("[a-z0-9]+", t.lower()))) for i, t in rows if i is not None and t]
    sets = [(i, s) for i, s in sets if len(s) >= least]
    return sorted({(min(i, j), max(i, j)) for (i, a), (j, b) in combinations(sets, 2) if i != j and len(a & b) >= similarity * len(a | b) - 1e-9})


def edited(rng, words, vocabulary):
    out = list(words)
    for _ in range(rng.randint(0, max(1, len(words) // 4))):
        kind = rng.random()
        if kind < 0.4 and out:
            out[rng.randrange(len(out))] = rng.choice(vocabulary)
        elif kind < 0.7:
            out.insert(rng.randrange(len(out) + 1), rng.choice(vocabulary))
        elif out:
            out.pop(rng.randrange(len(out)))
    rng.shuffle(out)
    return " ".join(out)


@pytest.mark.parametrize(("sizes", "similarity", "least"), [((5, 30), 0.7, 8), ((50, 110), 0.7, 8), ((8, 20), 0.8, 8), ((1, 6), 0.5, 1)])
def test_pairs_are_those_of_brute_force(spark, sizes, similarity, least):
    rng = random.Random(sum(sizes))
    vocabulary = [f"w{i}" for i in range(300)] + ["the"] * 60
    rows = []
    for i in range(0, 180, 3):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*sizes))]
        rows += [(i, " ".join(base)), (i + 1, edited(rng, base, vocabulary)), (i + 2, edited(rng, base, vocabulary).upper() + ".")]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, ""), (None, rows[0][1]), (500, rows[0][1])]
    df = spark.createDataFrame([("t", *r) for r in rows], "tab string, id bigint, text string")
    got = sorted((r.id_a, r.id_b) for r in N.record_pairs(df, similarity, least).collect())
    assert got == brute(rows, similarity, least) and len(got) > 20


def test_tables_stay_apart_and_empty(spark):
    text = "one two three four five six seven eight nine"
    df = spark.createDataFrame([("a", 1, text), ("b", 2, text), ("b", 3, text + " ten")], "tab string, id bigint, text string")
    assert [tuple(r) for r in N.record_pairs(df).collect()] == [("b", 2, 3)]
    member, pairs = N.near_duplicates(df)
    assert member.count() == 3 and pairs.count() == 1
    assert N.record_pairs(df.where("false")).count() == 0
    assert N.record_pairs(spark.createDataFrame([("a", 1, "x y"), ("a", 2, "x y")], "tab string, id bigint, text string")).count() == 0


def test_very_long_texts(spark):
    body = " ".join(f"n{i}" for i in range(6000))
    df = spark.createDataFrame([("a", 1, body), ("a", 2, body + " more"), ("a", 3, " ".join(f"m{i}" for i in range(6000)))], "tab string, id bigint, text string")
    assert [(r.id_a, r.id_b) for r in N.record_pairs(df).collect()] == [(1, 2)]


def test_large_cells_are_compared_in_parts(spark):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(14)]
    rows = [(i, " ".join([*rng.sample(common, 9), rng.choice(common[:3]) + "x"])) for i in range(400)]
    found = N.classes(spark.createDataFrame([("t", *r) for r in rows], "tab string, id bigint, text string"))
    sizes = found.count()
    hashed = found.select(F.lit(0).cast("bigint").alias("tab_no"), "class_id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    frequency = N.frequencies(found)
    parts = N._parts(hashed, frequency, 0.7, 20)
    assert parts.max() > 1
    cells = hashed.mapInArrow(lambda batches: N._cells(batches, frequency, 0.7, parts), "key bigint, class_id bigint, points bigint, about bigint")
    larger = cells.where("(about & 2) = 2").groupBy("key").count().agg(F.max("count")).first()[0]
    assert larger <= 60 < sizes  # no part compares more than a few times the 20 sets asked for with the cell
    plain = {(r.class_a, r.class_b) for r in N.similar_classes(found).collect()}
    assert plain and {(r.class_a, r.class_b) for r in N.similar_classes(found, cell=20).collect()} == plain
