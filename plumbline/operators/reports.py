"""Report datasets: totals by a domain, shares, page texts, nested exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import exact_sum, to_places


def totals_with_shares(df: DataFrame, key: str, amount: Column) -> DataFrame:
    """key, n_rows, total, share of the grand total (4 places; 0 where that is 0). The grand total is one row."""
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(exact_sum(amount), F.lit(0.0)).alias("total"))
    whole = totals.agg(F.sum(F.col("total").cast("decimal(28,6)")).cast("double").alias("whole"))
    joined = totals.crossJoin(F.broadcast(whole))  # one row
    return joined.select(key, "n_rows", to_places(F.col("total"), 2).alias("total"), F.coalesce(to_places(F.col("total") / F.nullif(F.col("whole"), F.lit(0.0)), 4), F.lit(0.0)).alias("share"))


def with_all_of_domain(df: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """Every value of a fixed domain, zeros for those that don't occur in a frame of (key, n_rows, total)."""
    every = df.sparkSession.createDataFrame([(d,) for d in domain], f"{key} string")
    return F.broadcast(every).join(df, key, "left").select(key, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("total", F.lit(0.0)).alias("total"))


def pages_of(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """Pages of marked texts (`--- PAGE n ---` lines): key, page_no, body; all of them, or the first `most`."""
    parts = df.select(key, F.posexplode(F.split(F.col(text), r"\n?--- PAGE [0-9]+ ---\n?")).alias("page_no", "body"))
    return parts.where((F.col("page_no") >= 1) & (F.col("page_no") <= most if most is not None else F.lit(True)))


def first_pages(df: DataFrame, key: str, text: str, most: int = 60) -> DataFrame:
    """key, body of marked texts: the first `most` pages with their markers, and a note where there are more."""
    marks = F.array_join(F.slice(F.split(F.col(text), r"(?=\n?--- PAGE [0-9]+ ---\n?)"), 1, most + 1), "")
    n = F.size(F.regexp_extract_all(F.col(text), F.lit(r"--- PAGE [0-9]+ ---"), F.lit(0)))
    return df.select(key, F.when(n > most, F.concat(marks, F.lit(f"\n[... {most} pages read ...]"))).otherwise(F.col(text)).alias("body"), n.alias("n_pages"))


def any_filled(*columns: str) -> Column:
    """Is any of the text columns neither null nor blank?"""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.trim(c) != "", F.lit(False))
    return found


def as_json(df: DataFrame, key: str, name: str = "document") -> DataFrame:
    """One JSON text per row, its columns in order."""
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(name))


def headline_rows(df: DataFrame, section: str, order: str) -> DataFrame:
    """Rows with a flag where the section changes in the order given, as a report prints a heading there."""
    firsts = df.groupBy(section).agg(F.min(order).alias("__first"))
    return df.join(firsts, section).withColumn("opens_section", F.col(order) == F.col("__first")).drop("__first")


def fold_continuations(lines: DataFrame, doc: str, line_no: str, text: str, header: str, most: int = 4) -> DataFrame:
    """Logical lines: each line that matches `header` takes up to `most` lines after it, up to a blank line or the next header.

    Windows run per document, so the lines of one document are in one task; documents are bounded by their pages.
    """
    order = Window.partitionBy(doc).orderBy(line_no)
    marked = lines.withColumn("opens", F.col(text).rlike(header)).withColumn("blank", F.trim(text) == "")
    grouped = marked.withColumn("group", F.sum(F.col("opens").cast("int")).over(order)).where(F.col("group") > 0)
    inside = Window.partitionBy(doc, "group").orderBy(line_no)
    placed = grouped.withColumn("at", F.row_number().over(inside) - 1).withColumn("blanks", F.sum(F.col("blank").cast("int")).over(inside))
    kept = placed.where((F.col("at") <= most) & (F.col("blanks") == 0))
    return kept.groupBy(doc, "group").agg(F.min(line_no).alias(line_no), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", F.trim(text).alias("t")))), lambda r: r["t"])).alias("logical_line")).drop("group")
