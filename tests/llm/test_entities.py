"""Matching by belief propagation: parts of descriptions, exact marginals on trees, one-to-one results."""

from __future__ import annotations

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("plumbline.llm")
from plumbline.llm import entities as E  # noqa: E402


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Grade beam, lightweight, 51 in x 77 in: Wusgreandreand 8989 at loading dock 5-375", ("wusgreandreand", "8989", "5375", ["51", "77"])),
        ("mech rm 2717; Raevvaklaeth 334; 10 x 3 in; column base plate", ("raevvaklaeth", "334", "2717", ["10", "3"])),
        ("R&R 3/4 in EMT conduit - Quioclim-6546 - 21in w - rm 9-121 [UOM = CLF]", ("quioclim", "6546", "9121", ["21", "3/4"])),
        ("Place 4,000 psi footing, Polclungem #3821, 3 inch thick, rm 6-921", ("polclungem", "3821", "6921", ["3", "4000"])),
        ("", (None, None, None, [])), (None, (None, None, None, [])),
    ],
)
def test_parts(text, parts):
    assert E.take_apart(text)[:4] == parts


def exact(pairs):
    """Marginals by enumerating all one-to-one sets of pairs."""
    total, marginal = 0.0, [0.0] * len(pairs)
    for size in range(len(pairs) + 1):
        for chosen in combinations(range(len(pairs)), size):
            if len({pairs[i][0] for i in chosen}) == size and len({pairs[i][1] for i in chosen}) == size:
                weight = math.exp(sum(pairs[i][2] for i in chosen))
                total += weight
                for i in chosen:
                    marginal[i] += weight
    return {(a, b): m / total for (a, b, _), m in zip(pairs, marginal)}


def test_marginals_are_exact_on_trees(spark):
    pairs = [(1, 10, 1.0), (1, 11, 0.5), (2, 11, -0.3), (2, 12, 2.0), (3, 13, 0.7)]
    got = {(r.item_id, r.row_id): r.confidence for r in E.marginals(spark.createDataFrame(pairs, "item_id bigint, row_id bigint, odds double").selectExpr("*", "1L as items", "1L as rows")).collect()}
    assert got == pytest.approx(exact(pairs), abs=5e-3)


def test_marginals_on_a_loop_keep_the_order(spark):
    pairs = [(1, 10, 3.0), (1, 11, 1.0), (2, 10, 1.0), (2, 11, 3.0)]
    got = {(r.item_id, r.row_id): r.confidence for r in E.marginals(spark.createDataFrame(pairs, "item_id bigint, row_id bigint, odds double").selectExpr("*", "1L as items", "1L as rows")).collect()}
    assert got[1, 10] > 0.8 and got[1, 11] < 0.2


def test_copies_count_as_often_as_they_are(spark):
    pairs = [(1, 10, 1.0), (1, 11, 0.5)]
    classes = spark.createDataFrame([(1, 10, 1, 1, 1.0), (1, 11, 1, 3, 0.5)], "item_id bigint, row_id bigint, items bigint, rows bigint, odds double")
    got = {(r.item_id, r.row_id): r.confidence for r in E.marginals(classes).collect()}
    expected = exact([*pairs, (1, 12, 0.5), (1, 13, 0.5)])
    assert got == pytest.approx({k: expected[k] for k in got}, abs=5e-3)


def test_many_rivals_settle(spark):
    pairs = spark.range(6).selectExpr("id item_id").crossJoin(spark.range(100, 106).selectExpr("id row_id")).selectExpr("*", "1L items", "1L rows", "case when item_id + 100 = row_id then 6.0 else 5.0 end odds")
    got = {(r.item_id, r.row_id): r.confidence for r in E.marginals(pairs).collect()}
    for i in range(6):
        assert abs(sum(got[i, j] for j in range(100, 106)) - 1) < 0.05 and got[i, i + 100] > 1.5 * got[i, (i + 1) % 6 + 100]


def test_words_are_learnt_from_the_texts(spark):
    texts = [f"Pump {k} hp Grundfos {4000 + k}, auditorium 5-{300 + k}" for k in range(10, 60)] + [f"pump Wilomat {k}, {k} hp" for k in range(700, 720)]
    known = E.learn(spark.createDataFrame([(t,) for t in [*texts, None]], "description string"))
    assert "auditorium" in known.places and "hp" in known.measures and "pump" in known.common | known.places or "pump" not in known.places
    assert E.take_apart("Pump 5 hp Grundfos 4412, auditorium 5375", known)[:4] == ("grundfos", "4412", "5375", ["5"])


LINES, ROWS = "item_id bigint, description string, quantity double, unit string, notes string, row_id string, p string", "row_id bigint, description string, quantity double, unit_of_measure string, notes string, item_id string"


def test_match(spark):
    lines = [
        (1, "Grade beam, 51 in x 77 in: Wusgrean 8989 at lab 5-375", 100.0, "CY", None), (2, "Grade beam, 51 in x 77 in: Wusgrean 8989 at lab 6-111", 50.0, "CY", None),
        (3, "Coping, 8 in wide: Dalber 77 at gym 1-234", 200.0, "LF", None), (4, None, 1.0, "EA", None), (5, " ", 1.0, "EA", None), (3, "Coping, 8 in wide: Dalber 77 at gym 1-234", 200.0, "LF", None),
    ]
    rows = [
        (10, "rm 5-375, wusgraen-8989, grade beam 51x77 in", 101.0, "cu yd", None), (11, "coping Dalber #77 8 in w @ 1-234", 2.0, None, "UOM = CLF"), (12, "coping Dalber #77 8 in w @ 1-234", 2.0, "CLF", None),
        (13, "coping Dalber #77 9 in w @ 1-999", 200.0, "LF", None), (14, None, None, None, None),
    ]
    a = spark.createDataFrame([(*x, "clash", "clash") for x in lines], LINES)
    b = spark.createDataFrame([(*x, "clash") for x in rows], ROWS)
    got = {(r.item_id, r.row_id): r.confidence for r in E.match(a, b).collect()}
    assert set(got) == {(1, 10), (3, 11)} and got[1, 10] > 0.9 and 0.3 < got[3, 11] < 0.6  # of two equal rows the smaller id, in doubt
    assert E.match(a.where("false"), b).count() == 0 and E.match(a, b.where("false")).count() == 0


def _lines(spark, rows):
    return spark.createDataFrame([(i, d, q, u, None, "clash", "clash") for i, d, q, u in rows], LINES)


def _rows(spark, rows):
    return spark.createDataFrame([(i, d, q, u, None, "clash") for i, d, q, u in rows], ROWS)


COPING, QUOTED = "Coping, 8 in wide: Dalber 77 at gym 1-234", "coping Dalber #77 8 in w @ 1-234"


def _pairs(df):
    got = [(r.item_id, r.row_id) for r in df.collect()]
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    return sorted(got)


@pytest.mark.parametrize(("lines", "rows"), [(2, 2), (3, 2), (2, 5), (40, 40), (40, 39)])
def test_all_copies_match(spark, lines, rows):
    a = _lines(spark, [(i, COPING, 200.0, "LF") for i in range(1, lines + 1)] * 2)
    b = _rows(spark, [(100 + j, QUOTED, 200.0, "LF") for j in range(1, rows + 1)])
    assert _pairs(E.match(a, b)) == [(k, 100 + k) for k in range(1, min(lines, rows) + 1)]


def test_copies_match_rows_of_other_wording(spark):
    rows = [(10, QUOTED, 200.0, "LF"), (11, "Dalber-77 coping 8 in, 1-234", 201.0, "LF"), (12, QUOTED, 200.0, "LF"), (13, "Dalber-77 coping 9 in, 1-999", 20.0, "LF")]
    got = _pairs(E.match(_lines(spark, [(i, COPING, 200.0, "LF") for i in range(1, 6)]), _rows(spark, rows)))
    assert [i for i, _ in got] == [1, 2, 3] and sorted(j for _, j in got) == [10, 11, 12]


def test_rows_of_near_equal_lines_are_not_left_out(spark):
    lines = [(1, COPING, 200.0, "LF"), (2, "Coping 8 in wide, Dalber 77, gym 1-234 wide", 200.5, "LF")]
    rows = [(10, QUOTED, 200.0, "LF"), (11, "Dalber-77 coping 8 in, 1-234", 201.0, "LF")]
    got = _pairs(E.match(_lines(spark, lines), _rows(spark, rows)))
    assert [i for i, _ in got] == [1, 2] and [j for _, j in sorted(got, key=lambda p: p[1])] == [10, 11]


def test_repeated_tables_give_repeated_pairs(spark, small):
    from plumbline.sources.tables import load

    lines, rows = load(spark, small, "takeoff_template").where("list_name = 'line_items'"), load(spark, small, "vendor_rows")
    step = 10**12
    more = lambda df, key: df.crossJoin(spark.range(4).select(F.col("id").alias("nth"))).withColumn(key, F.col(key) + F.col("nth") * step).drop("nth")
    one = _pairs(E.match(lines, rows))
    assert one and _pairs(E.match(more(lines, "item_id"), more(rows, "row_id"))) == sorted((i + k * step, j + k * step) for i, j in one for k in range(4))


@pytest.mark.parametrize(("items", "rows"), [(2, 2), (50, 50), (50, 40), (1, 30)])
def test_messages_between_copies_stand_still_soon(spark, monkeypatch, items, rows):
    rounds, message = [], E._message
    monkeypatch.setattr(E, "_message", lambda *a: rounds.append(a) or message(*a))
    pairs = spark.createDataFrame([(1, 10, items, rows, 12.0), (1, 11, items, rows, -3.0), (2, 11, items, rows, 12.0)], "item_id bigint, row_id bigint, items bigint, rows bigint, odds double")
    got = {(r.item_id, r.row_id): r.confidence for r in E.marginals(pairs).collect()}
    assert len(rounds) <= 2 * 30
    for pair in ((1, 10), (2, 11)):
        assert got[pair] * max(items, rows) == pytest.approx(1, abs=0.05)


def test_equal_texts_are_learnt_from_once(spark):
    texts = ["Roof panel, loading dock 3488 Treanecoult #3120"] * 20 + [f"Pump {k} hp, auditorium 5-{300 + k}" for k in range(10, 60)]
    known = E.learn(spark.createDataFrame([(t,) for t in texts], "description string"))
    assert "treanecoult" not in known.measures and "hp" in known.measures


@pytest.mark.parametrize("copies", [1, 20])
def test_doubtful_pairs_do_not_match_by_being_repeated(spark, copies):
    a = _lines(spark, [(i, COPING, None, "LF") for i in range(copies)])
    b = _rows(spark, [(100 + j, QUOTED.replace("1-234", "1-999"), None, "LF") for j in range(copies)])
    assert _pairs(E.match(a, b)) == []
