"""Common units: aliases, units told in text, raw widths, edge cases."""

from __future__ import annotations

import pytest

from plumbline.operators import units as U


@pytest.mark.parametrize(
    ("text", "family", "alias"),
    [
        ("UOM = hundred LF", "material", "hundred lf"),
        ("Qty given in lin. ft..", "material", "lin. ft"),
        ("(unit: EA (units))", "material", "ea (units)"),
        ("measured in m² off S-5.1", "material", "m²"),
        ("pipe, 3 in wide [counted by /100]", "material", "/100"),
        ("41 LF perimeter less 2 openings", "material", None),
        ("Carry 10% waste, pattern repeat is 21 in.", "material", None),
        ("rooftop unit serving gym (kW at design)", "heat", "kw"),
        ("Capacity column is MMBtu/h.", "heat", "mmbtu/h"),
        ("", "material", None),
        (None, "material", None),
    ],
)
def test_told(text, family, alias):
    assert U.finder(family).told(text) == alias


@pytest.mark.parametrize(
    ("raw", "inches", "other"),
    [
        ("3'-0\"", 36, True), ("2 FT. 10 IN.", 34, True), ("3′-5 3/4″", 41.75, True), ("914 mm", 35.984, True), ("0.914m", 35.984, True), ("91.4 cm", 35.984, True), ("36''", 36, False),
        ("35 3/4 in", 35.75, False), ("36", None, False), ("unk", None, False), ("3/0 in", None, False), (None, None, False), ("3 ft door", None, False),
    ],
)
def test_widths(raw, inches, other):
    value, differs = U.finder("width").measure(raw)
    assert differs == other and (value is None) == (inches is None) and (inches is None or abs(value - inches) < 0.01)


def test_factors():
    def of(family, alias):
        return next(f for fam, a, _, f in U.alias_rows() if (fam, a) == (family, alias))

    assert of("material", "m3") == pytest.approx(1.30795, abs=1e-5)
    assert of("water", "l/s") == pytest.approx(15.8503, abs=1e-4)
    assert of("air", "m3/s") == pytest.approx(2118.88, abs=1e-2)
    assert of("heat", "kw") == pytest.approx(3.41214, abs=1e-5)
    assert len({(f, a) for f, a, _, _ in U.alias_rows()}) == len(U.alias_rows())


def test_operator(spark, rows):
    takeoff = spark.createDataFrame(
        [
            (1, 2.0, "CLF", None, "a", "x"), (2, 5.0, "LF", "UOM = CLF", "a", "x"), (3, 3.0, None, "UOM = dozen", "a", "x"), (4, 3.0, None, None, None, "x"),
            (5, None, "CLF", None, "a", "x"), (6, 9.0, "LS", None, "a", "x"), (7, 2.0, " Sq. Yds. ", None, "a", "x"), (8, 1.0, "  ", "", "b [counted by gross]", "x"), (7, 2.0, "SY", None, "a", "x"),
        ],
        "item_id bigint, quantity double, unit string, notes string, description string, family string",
    )
    got = rows(U.common_units(takeoff=takeoff).select("row_id", "unit", "qty"))
    assert got == [(1, "LF", 200.0), (3, "EA", 36.0), (7, "SF", 18.0), (7, "SF", 18.0), (8, "EA", 144.0)]
    hvac = spark.createDataFrame([(1, "AHU", 10.0, "kW", None, None), (2, "pump", 1.0, "L/s", None, None), (3, "BOILER", 2.0, "TONS", None, None), (4, None, 2.0, "TONS", None, None)], "record_id bigint, equipment_type string, capacity_value double, capacity_unit string, notes string, description string")
    assert [(r[0], r[1], round(r[2], 3)) for r in rows(U.common_units(hvac=hvac).select("row_id", "unit", "qty"))] == [(2, "GPM", 15.85), (3, "MBH", 24.0)]
    assert U.common_units(takeoff=takeoff.where("false")).count() == 0
    with pytest.raises(ValueError):
        U.common_units()
