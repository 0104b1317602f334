"""One rounding for all money and confidences: half up on DECIMAL(18,6), back to double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_places(value: Column, places: int) -> Column:
    return F.round(value.cast("decimal(18,6)"), places).cast("double")


def exact_sum(value: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(value.cast("decimal(18,6)")).cast("double")
