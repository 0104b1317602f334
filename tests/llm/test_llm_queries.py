"""Queries of the subpackage run on the smallest tables and agree with their SQL, where they have one."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

pytest.importorskip("plumbline.llm")
from plumbline.llm import catalogue  # noqa: E402

COLUMNS = {
    "p1_found": ["tab", "field_name", "row_id"], "p2_found": ["tab", "first_id", "keep_id"], "p5_found": ["tab", "id_a", "id_b"], "p6_found": ["item_id", "row_id"],
    "p7_found": ["bundle_id", "cut"], "p8_ids": ["doc_id", "ids"], "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, name):
    df = catalogue.queries()[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(map(repr, rows))) == len(rows)
    if name in catalogue.oracle_sql():
        con = duckdb.connect()
        for p in Path(small).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
        rel = con.sql(catalogue.oracle_sql()[name])
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
