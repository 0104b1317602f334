"""Loading of the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of `folder`, a parquet file or a folder of parquet files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only `columns`, so that extra columns of an input, whatever their names, cannot clash with ours.

    A missing column raises ValueError that names it.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the input lacks the columns {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])
