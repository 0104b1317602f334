"""Schedule tables and alternates on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import alternates, families, schedules

ROOMS = (1, ["ROOM #", "NAME", "AREA", "PERIMETER", "FLOOR", "BASE", "WALL", "CEILING", "CLG HT"], [["101", "Office", "180", "54", "VCT-1", "RB-1", "PT-1", "ACT-1", "9'-0\""], ["102", "Lobby", "240", "62", "TILE-1", "CB-1", "PT-2", "ACT-1", "10'-0\""]])
DOORS = (2, ["MARK", "FRAME WIDTH", "WIDTH", "HEIGHT", "FIRE RATING"], [["101A", "x", "3'-0\"", "7'-0\"", "90 MIN"], ["-", "", "", "", ""]])
SCHEMA = "table_id int, headers array<string>, rows array<array<string>>"


def test_rooms_and_doors(spark, rows):
    tables = spark.createDataFrame([ROOMS, DOORS], SCHEMA)
    assert rows(schedules.typed_records(tables.where("table_id = 1"), "room").drop("row_no")) == [(1, "101", "Office", 180.0, 54.0, 9.0), (1, "102", "Lobby", 240.0, 62.0, 10.0)]
    assert rows(schedules.typed_records(tables.where("table_id = 2"), "door").select("mark", "width_in", "height_in", "frame", "fire_rating")) == [("101A", 36.0, 84.0, "x", "90 MIN")]
    assert rows(tables.select("table_id", schedules.schedule_kind(F.col("headers")))) == [(1, "room"), (2, "door")]  # six words of a room schedule, five of a finish schedule
    assert schedules.row_maps(tables).where("table_id = 1 and row_no = 0").first().cells["CLG HT"] == "9'-0\""


def test_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(families.item_type("hvac", F.lit("RTU-147"), F.lit("x"))) == "RTU" and one(families.item_type("hvac", F.lit("Z-1"), F.lit("exhaust fan"))) == "FAN" and one(families.item_type("hvac", F.lit("Z"), F.lit("?"))) == "OTHER"
    assert one(families.by_words(F.lit("VCT-9"), families.FLOOR_SECTIONS)) == "09 65 19" and one(schedules.record_confidence(F.lit("1"), F.lit(""))) == 0.8
    assert one(schedules.dominant(F.array(*map(F.lit, ["window", "door", "room", "hvac"])))) == ["door", "hvac"]
    assert one(schedules.prepass_score([F.lit(True)] * 4 + [F.lit(False)])) == pytest.approx(0.85)
    panels = spark.sql("select 'P1' panel, array(named_struct('breaker_amps', 20), named_struct('breaker_amps', 20), named_struct('breaker_amps', cast(null as int))) circuits")
    assert [tuple(r) for r in schedules.breaker_groups(panels).collect()] == [("P1", 20, 2)]


def test_alternates(spark):
    lines = spark.createDataFrame(
        [(1, 1, "Alternate No. 1: Replace carpet in the lobby with terrazzo tile $12,500 ADD"), (1, 2, "Deduct Alternate 2 - omit canopy $4,000"), (1, 3, "ALTERNATES SECTION"), (1, 4, "Alt #1: $____"), (1, 5, "other")],
        "doc int, n int, t string",
    )
    found = alternates.from_lines(lines, "doc", "n", "t")
    got = {r.n: (r.alternate_id, r.alternate_type, r.cost_delta) for r in found.collect()}
    assert got == {1: ("Alternate 1", "ADDITIVE", 12500.0), 2: ("Deduct Alternate 2", "DEDUCTIVE", -4000.0), 4: ("Alternate 1", "ADDITIVE", None)}
    assert sorted((r.alternate_id, r.n) for r in alternates.reconcile(found, "n").collect()) == [("Alternate 1", 1), ("Deduct Alternate 2", 2)]


@pytest.mark.parametrize(
    ("family", "headers", "cells", "expected"),
    [
        ("window", ["WINDOW MARK", "WIDTH", "HEIGHT", "SILL HEIGHT"], ["W1", "3'-0\"", "48", "2'-6\""], {"mark": "W1", "width_in": 36.0, "height_in": 48.0, "sill_in": 30.0}),
        ("finish", ["ROOM #", "ROOM NAME", "FLOOR", "CLG", "CLG HT"], ["101", "Lab", "VCT-1", "ACT-1", "9'-6\""], {"room_number": "101", "floor_finish": "VCT-1", "ceiling_finish": "ACT-1", "height_ft": 9.5}),
        ("panel", ["CKT", "TRIP", "LOAD"], ["1", "20A", "Lights"], {"circuit": "1", "breaker_amps": 20.0, "load": "Lights"}),
        ("lighting", ["TYPE", "WATTAGE", "LUMENS", "VOLTAGE"], ["A1", "32 W", "4,000", "277V"], {"tag": "A1", "watts": 32.0, "lumens": 4000.0, "volts": 277}),
        ("hvac", ["UNIT TAG", "CFM", "HP", "VOLTAGE"], ["AHU-1", "2,400", "5", "480/3"], {"tag": "AHU-1", "cfm": 2400.0, "hp": 5.0, "volts": 480, "phase_count": 3}),
        ("plumbing", ["MARK", "WASTE", "CW", "FLUSH"], ["WC-1", "4", "1/2\"", "1.28 gpf"], {"tag": "WC-1", "waste_in": 4.0, "gpf": 1.28}),
        ("kitchen", ["ITEM", "QTY", "DESCRIPTION", "KW"], ["12", "2", "Oven", "10.5 kW"], {"tag": "12", "quantity": 2, "description": "Oven", "kw": 10.5}),
        ("lab", ["TAG", "WIDTH", "DEPTH"], ["C1", "36\"", "24"], {"tag": "C1", "width_in": 36.0, "depth_in": 24.0}),
        ("av", ["DEVICE", "QTY", "RESOLUTION", "POWER"], ["D1", "1", "3840x2160", "300"], {"tag": "D1", "resolution": "3840x2160", "watts": 300.0}),
        ("security", ["DEVICE", "LOCATION", "QTY"], ["CR-1", "101", "1"], {"tag": "CR-1", "room": "101", "quantity": 1}),
    ],
)
def test_families(spark, family, headers, cells, expected):
    tables = spark.createDataFrame([(1, headers, [cells, ["-"] * len(cells), []])], SCHEMA)
    got = schedules.typed_records(tables, family).collect()
    assert len(got) == 1 and {k: got[0][k] for k in expected} == expected
