"""Facts from lines on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lines


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (lines.title_line, "A-101\nFirst Floor Plan\nx", "First Floor Plan"), (lines.title_line, "x" * 90 + " SECTION", None), (lines.title_line, None, None),
        (lines.is_subtotal, "Sub-total: 5", True), (lines.is_subtotal, "Grand Total", True), (lines.is_subtotal, "Total station survey", False), (lines.is_subtotal, None, False),
        (lambda c: lines.after_label(c, "award date"), "x\nAward Date : 3 May \ny", "3 May"), (lambda c: lines.after_label(c, "award date"), "x", None),
        (lambda c: lines.index_value(c, "index", 100, 99999), "In 2024 the Index for 2024 stood at 13,532.1 up", 13532.1), (lambda c: lines.index_value(c, "index", 100, 99999), "none", None),
    ],
)
def test_facts(spark, function, value, expected):
    assert one(spark, function, value) == expected


def test_wages_and_json(spark, rows):
    pages = spark.createDataFrame([(1, "TRADE BASE\nElectrician ..... $30.50 10.25\nPlumber 31.00 9.00 40.00\nLaborer 18.00\nPage 2")], "doc int, t string")
    assert rows(lines.wage_rates(pages, "doc", "t").drop("line_no")) == [(1, "Electrician", 30.5, 10.25, 40.75), (1, "Laborer", 18.0, None, 18.0), (1, "Plumber", 31.0, 9.0, 40.0)]
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "broken"), (3, None)], "id int, j string")
    assert rows(lines.lenient(df, "j", "a double, b string")) == [(1, 1.0, "x"), (2, None, None), (3, None, None)]
