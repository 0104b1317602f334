"""Joins and rankings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT = "__salt"


def salted_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = 24) -> DataFrame:
    """`rows` joined with `lookup`, which has at most one row per key.

    `rows` gets a salt from the hash of column `spread` (a row id), and `lookup`, one row per key, is
    repeated once per salt, so a key with a third of all rows is shared by `salts` tasks. `how` is inner,
    left, left_semi or left_anti. Null keys match nothing, as in SQL. Columns of `lookup` apart from the
    keys must not occur in `rows`.
    """
    salted = rows.withColumn(SALT, F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    copies = lookup.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, SALT], how).drop(SALT)


#: A key is hot if it has more rows than this and than one in HOT_KEYS of all rows; so there are at most HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 50_000, 500


def counted_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `lookup`, which has one row per key and, in `count`, how many of `rows` have the key.

    The lookup rows of hot keys are broadcast (at most HOT_KEYS of them, whatever the data), so a key with a third of
    all rows stays spread over all tasks and is not shuffled; the other keys are shuffled. Without hot keys it is a
    plain join. `how` is inner or left; null keys match nothing. `count` doesn't come out.
    """
    total, most = lookup.agg(F.sum(count), F.max(count)).first()
    if not most or most <= HOT_ROWS:
        return rows.join(lookup.drop(count), on, how)
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(lookup.where(F.col(count) > least).drop(count))
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(lookup.where(F.col(count) <= least).drop(count), on, how)
    return rows.join(hot, on).unionByName(cold)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows of each key in an order that leaves no ties, with their rank from 1.

    A row_number below a limit is cut to `k` rows a key in every input partition before the shuffle, so a hot key
    sends no more than any other.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
