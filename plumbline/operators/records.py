"""Keyed deduplication, votes and merges of records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import to_places
from ..functions.similarity import first_leaders
from ..functions.text import norm
from .skew import top_rows


def truthy(column: str, kind: str) -> Column:
    """1 for a value that is neither null, empty, zero nor false."""
    c = F.col(column)
    if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
        test = c != 0
    elif kind == "boolean":
        test = c
    elif kind.startswith(("array", "map")):
        test = F.size(c) > 0
    else:
        test = c.cast("string") != ""
    return F.coalesce(test, F.lit(False)).cast("int")


def most_complete(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with most truthy fields, the smallest `order` on a tie; first_seen is the key's smallest order.

    A single aggregation: the best row travels as a struct, so nothing is sorted and partial results combine early.
    """
    kinds = dict(df.dtypes)
    filled = sum((truthy(f, kinds[f]) for f in fields[1:]), truthy(fields[0], kinds[fields[0]]))
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(filled, -F.col(order))).alias("best"), F.min(order).alias("first_seen"))
    return best.select(*keys, "best.*", "first_seen")


def first_filled(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str) -> DataFrame:
    """One row per key with the first non-null value of every field in the order of `order`, and the number of rows."""
    firsts = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*firsts, F.count(F.lit(1)).alias("n_rows"))


def distinct_content(df: DataFrame, text: str, path: str) -> DataFrame:
    """One row per distinct content: the one of the shortest path, then the first in order."""
    hashed = df.where(F.col(text).isNotNull()).withColumn("content_hash", F.sha2(F.col(text), 256))
    others = [c for c in df.columns if c != text]
    return hashed.groupBy("content_hash").agg(F.min_by(F.struct(*others), F.struct(F.length(path), F.col(path))).alias("kept"), F.count(F.lit(1)).alias("copies")).select("content_hash", "copies", "kept.*")


def vote(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-blank value of each key, the largest on a tie, with its votes."""
    counted = df.where(F.trim(value) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    return counted.groupBy(*keys).agg(F.max(F.struct("votes", value)).alias("won")).select(*keys, F.col(f"won.{value}").alias(value), F.col("won.votes").alias("votes"))


def merge_quantities(df: DataFrame, keys: Sequence[str], quantity: str, confidence: str, sources: str) -> DataFrame:
    """Rows of one key summed: quantity, quantity-weighted confidence (2 places), distinct sources in order."""
    q = F.coalesce(F.col(quantity), F.lit(0.0)).cast("decimal(18,6)")
    weighted = (q * F.coalesce(F.col(confidence), F.lit(0.0)).cast("decimal(9,6)")).cast("decimal(28,9)")
    summed = df.groupBy(*keys).agg(F.sum(q).alias("q"), F.sum(weighted).alias("w"), F.count(F.lit(1)).alias("n_rows"))
    listed = df.select(*keys, F.explode(sources).alias("source")).groupBy(*keys).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    joined = summed.alias("s").join(listed.alias("l"), same, "left")
    return joined.select(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("q").cast("double").alias("quantity"), to_places(F.col("w") / F.nullif(F.col("q"), F.lit(0)), 2).alias("confidence"), "n_rows", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def fold_quantities(df: DataFrame, keys: Sequence[str], quantity: str, confidence: str, order: str) -> DataFrame:
    """As merge_quantities, but the confidence is rounded to 2 places after every row, in order, as a running merge would.

    Order matters, so a key's rows are gathered: keys are narrow (one item of one bid), never a whole source.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(F.col(quantity), F.lit(0.0)).alias("q"), F.coalesce(F.col(confidence), F.lit(0.0)).alias("c"))))
    start = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("c"))

    def step(s: Column, r: Column) -> Column:
        q = s["q"] + r["q"]
        mixed = F.when(q != 0, to_places((s["c"] * s["q"] + r["c"] * r["q"]) / q, 2)).otherwise(s["c"])
        return F.struct(q.alias("q"), F.when(s["q"] == 0, F.when(q != 0, r["c"]).otherwise(s["c"])).otherwise(mixed).alias("c"))

    folded = df.groupBy(*keys).agg(rows.alias("rows")).withColumn("end", F.aggregate("rows", start, step))
    return folded.select(*keys, to_places(F.col("end.q"), 6).alias("quantity"), F.col("end.c").alias("confidence"), F.size("rows").alias("n_rows"))


def leader_clusters(df: DataFrame, block: str, text: str, order: str, threshold: float) -> DataFrame:
    """Greedy clusters within a block: in order, a row joins the first leader at least so similar, else leads itself.

    Texts are compared in normalised form, those without letters and digits left out. A text is compared with every
    leader of its block, unless bounds by their characters and shared words tell that they can't be similar enough.
    Result: block, text, leader, both in the spelling they came in.
    """
    distinct = df.groupBy(block, text).agg(F.min(order).alias("at")).withColumn("__norm", norm(F.col(text))).where("__norm <> ''")
    kinds = dict(distinct.dtypes)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", text])
        firsts = rows.drop_duplicates("__norm")
        led = dict(zip(firsts["__norm"], firsts[text].to_numpy()[first_leaders(list(firsts["__norm"]), threshold)]))
        return pd.DataFrame({block: rows[block], text: rows[text], "leader": rows["__norm"].map(led)})

    return distinct.groupBy(block).applyInPandas(cluster, f"{block} {kinds[block]}, {text} string, leader string")


def page_sample(pages: Column) -> Column:
    """Pages (from 0) to read of a document: all of 3, first, middle and last five of 10, else ends and fifths between."""
    ends = F.concat(F.sequence(F.lit(0), F.lit(4)), F.sequence(pages - 5, pages - 1))
    middle = F.floor(pages / 2).cast("int")
    few = F.concat(ends, F.sequence(middle - 2, middle + 2))
    many = F.concat(ends, F.array(*[F.floor(pages * share / 100).cast("int") for share in (20, 35, 50, 65, 80)]))
    chosen = F.when(pages <= 3, F.sequence(F.lit(0), pages - 1)).when(pages <= 10, few).otherwise(many)
    return F.when(pages > 0, F.array_sort(F.array_distinct(F.filter(chosen, lambda p: (p >= 0) & (p < pages))))).otherwise(F.array().cast("array<int>"))


def cluster_lines(df: DataFrame, page: str, x: str, y: str, text: str, reach: float = 4.0) -> DataFrame:
    """Rows of a table from placed words: a word belongs to a row while its y is within `reach` of the row's first y.

    The gap is from the row's start, not from the last word, so it is a fold over one page's words. Result: page,
    row_no, cells in order of x.
    """

    def rows_of(words: pd.DataFrame) -> pd.DataFrame:
        rows: list[list[tuple[float, str]]] = []
        first = None
        for w in words.sort_values([y, x, text]).itertuples():
            at = getattr(w, y)
            if first is None or at - first > reach:
                rows.append([])
                first = at
            rows[-1].append((getattr(w, x), getattr(w, text)))
        return pd.DataFrame([(words[page].iloc[0], n, [c for _, c in sorted(r)]) for n, r in enumerate(rows)], columns=[page, "row_no", "cells"])

    return df.groupBy(page).applyInPandas(rows_of, f"{page} {dict(df.dtypes)[page]}, row_no int, cells array<string>")


def replay(log: DataFrame, key: str, order: str, value: str, depth: int = 10) -> DataFrame:
    """State of an append-only log: current value, the value before (what a revert restores), and the last `depth` values."""
    counts = log.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_changes"))
    newest = top_rows(log.select(key, F.col(order).alias("at"), F.col(value).alias("v")), [key], [F.desc("at")], max(2, depth))
    kept = newest.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "v")), asc=False)["v"].alias("v"))  # at most `depth`, oldest first
    state = kept.select(key, F.try_element_at("v", F.lit(-1)).alias("current"), F.try_element_at("v", F.lit(-2)).alias("before"), F.slice("v", F.greatest(F.lit(1), F.size("v") - depth + 1), depth).alias("history"))
    return state.join(counts, key)
