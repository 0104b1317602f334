"""Queries of the general data problems and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse_rows, units
from ..sources.tables import load
from . import problem_sql


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of vendor price files that fail to load, with the reason."""
    return parse_rows.failed_rows(load(spark, folder, "vendor_lines"))


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The records that load, as typed vendor rows."""
    return parse_rows.load_rows(load(spark, folder, "vendor_lines"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values recorded in another unit than the common one, converted and rounded to whole."""
    names = ("takeoff_template", "vendor_rows", "hvac_records", "door_records")
    rows = units.common_units(*[load(spark, folder, n) for n in names])
    return rows.select("tab", "row_id", "unit", F.floor(F.col("qty") + 0.5).cast("bigint").alias("whole_qty")).where("whole_qty is not null")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found, "p3_loaded": p3_loaded, "p4_found": p4_found}


def oracle_sql() -> dict[str, str]:
    return dict(problem_sql.SQL)
