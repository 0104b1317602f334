"""Records that fail to parse: reasons, edge cases, blocks against one-by-one reading."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from plumbline.operators import parse_rows as P

SCHEMA = "line_id bigint, file_name string, line_no int, raw_line string, raw string, reason string"
HEAD = "desc,rate,q,uom"


def frame(spark, records, header=HEAD, name="a.csv"):
    lines = [(1, name, 1, header), *((i + 2, name, i + 2, r) for i, r in enumerate(records))]
    return spark.createDataFrame([(*x, "clash", "clash") for x in lines], SCHEMA)


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        ("pipe,1.50,2,EA", None),
        ('"pipe, 2"" dia","$ 1,250.00", 3 ,EA', None),
        ('"two\nlines",1,,EA', None),
        ('pipe 2" dia,1,2,EA', "quoting"),
        ('"pipe" x,1,2,EA', "quoting"),
        ('"pipe,1,2,EA', "quoting"),
        ('pipe, "1",2,EA', "quoting"),
        ("pipe,1,2", "columns"),
        ("pipe,1,2,EA,dup", "columns"),
        ("", "columns"),
        (None, "columns"),
        ("  ,1,2,EA", "value"),
        ("pipe,,2,EA", "value"),
        ("pipe,-1,2,EA", "value"),
        ("pipe,12,34.50x,EA", "value"),
        ("pipe,NaN,2,EA", "value"),
        ("pipe,1,twelve,EA", "value"),
        ('pipe,"1,23.0",2,EA', "value"),
    ],
)
def test_reason(record, reason):
    assert P.diagnose(record, *P.read_header(HEAD))[0] == reason


def test_layouts():
    assert P.read_header("﻿Item|Qty|UOM|Unit Price|Comments") == ("|", ["description", "quantity", "unit_of_measure", "unit_cost", "notes"])
    assert P.read_header("a;b,c;d")[0] == ";"
    assert P.read_header(None) == (",", [None])


def test_operator(spark, rows):
    good = [f"item {i},{i}.25,{i},EA" for i in range(40)]
    lines = frame(spark, [*good, 'bad "x,1,2,EA', "short,1", " ,1,1,EA"])
    lines = lines.union(lines.where("line_id = 42"))  # a repeated row
    out = P.parse_records(lines)
    assert rows(out.where("reason is not null").select("line_id", "reason")) == [(42, "quoting"), (42, "quoting"), (43, "columns"), (44, "value")]
    loaded = {r.line_id: r for r in P.load_rows(lines).collect()}
    assert len(loaded) == 40 and loaded[5].unit_cost == 3.25 and loaded[5].quantity == 3.0 and loaded[5].vendor is None


def test_empty_and_headerless(spark, rows):
    empty = frame(spark, []).where("false")
    assert P.failed_rows(empty).count() == 0 and P.load_rows(empty).count() == 0
    orphan = frame(spark, ["a,b", 'a "b']).where("line_no > 1")
    assert rows(P.failed_rows(orphan)) == [(2, "columns"), (3, "quoting")]


def test_blocks_agree_with_single_records():
    rng = random.Random(5)
    pieces = ["pipe", '"a ""b"""', "1.5", "$ 2", "", ",", '"', "x", "\n", '"1,200"', "-1", " 3 "]
    records = [",".join(rng.choice(pieces) for _ in range(rng.choice([3, 4, 4, 4, 5]))) for _ in range(3000)]
    separator, slots = P.read_header(HEAD)
    out: list[pa.Table] = []
    P._block(pa.array(range(len(records))), pa.array(records), separator, slots, out)
    table = pa.concat_tables(out).to_pydict()
    got = dict(zip(table["line_id"], table["reason"]))
    assert got == {i: P.diagnose(r, separator, slots)[0] for i, r in enumerate(records)}
    assert sum(v is None for v in got.values()) > 20


def test_missing_column(spark):
    with pytest.raises(ValueError, match="raw_line"):
        P.parse_records(spark.createDataFrame([(1, "a", 1)], "line_id bigint, file_name string, line_no int"))
