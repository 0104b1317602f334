"""File listings, delimited files with vendor headers, versioned snapshots and export sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import distinct_content

#: Series snapshots as they are stored.
SNAPSHOT = "source string, series string, unit string, value double, region string, period string, fetched_at timestamp_ntz"


def listed(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = True, most_mb: float | None = None) -> DataFrame:
    """path, length, modified of files; the size limit is checked before any content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = files.where(F.col("length") <= most_mb * 1e6) if most_mb is not None else files
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """One row per distinct content: content_hash, copies, path (shortest, then first)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return distinct_content(files.select("path", F.base64("content").alias("body")), "body", "path")


def raw_records(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """file_name, line_no, line_id, raw_line of vendor files, ready for operators.parse_rows (one record per line)."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).withColumn("file_name", F.col("_metadata.file_name"))
    rows = lines.select("file_name", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("at", "raw_line"))
    rows = rows.where("raw_line <> ''").withColumn("line_no", F.col("at") + 1)
    return rows.select("file_name", "line_no", F.xxhash64("file_name", "line_no").alias("line_id"), "raw_line")


def safe_token(token: Column) -> Column:
    """A path part: other characters than letters, digits, dot, dash and underscore to underscores; empty and dots fail."""
    clean = F.regexp_replace(F.trim(token), r"[^A-Za-z0-9._-]+", "_")
    return F.when(~clean.isin("", ".", ".."), clean).otherwise(F.raise_error(F.concat(F.lit("unsafe path part: "), token)))


def write_snapshots(rows: DataFrame, folder: str) -> None:
    """Append snapshots, partitioned by source; history is kept, reads choose."""
    rows.withColumn("source", safe_token(F.col("source"))).write.mode("append").partitionBy("source").parquet(folder)


def latest(rows: DataFrame, keys: tuple[str, ...] = ("source", "series")) -> DataFrame:
    """The newest snapshot of each key by fetched_at, then period, then value."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("fetched_at", "period", "value")).alias("s"))
    return best.select(*keys, "s.*")


def history(rows: DataFrame) -> DataFrame:
    """One snapshot per source, series and period: the newest fetched."""
    return latest(rows, ("source", "series", "period"))


def export_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def export_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(folder)
