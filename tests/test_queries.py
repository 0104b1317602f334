"""Every query of the core runs on the smallest tables and agrees with its SQL, where it has one."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from plumbline.plans import catalogue, data_problems, fact_plans, price_plans, report_plans, schedule_plans

PLANS = (catalogue, data_problems, schedule_plans, report_plans, price_plans, fact_plans)
QUERIES = {name: query for p in PLANS for name, query in p.queries().items()}
SQL = {name: sql for p in PLANS for name, sql in p.oracle_sql().items()}


def cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, tables, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        rel = tables.sql(SQL[name])
        at = [rel.columns.index(c) for c in columns]
        assert sorted(rel.columns) == columns
        assert got == sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and entry.entry(spark).columns == ["tab", "row_id", "unit", "whole_qty"]


def test_core_does_not_need_llm():
    root = Path(catalogue.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text().replace("__future__", ""), p
