"""Queries of the problems on texts and records for training data, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import chunks, entities, leakage, neardup, oracles, residue, subjects, survivor, tokens


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fields with template slots, filler, error pages or scripts-required notices."""
    takeoff = residue.field_rows(load(spark, folder, "takeoff_template"), "takeoff_template", "item_id", ["notes", "sq_ft"], "bid_id")
    prices = residue.field_rows(load(spark, folder, "price_sheet"), "price_sheet", "line_id", ["notes"], "bid_id")
    return residue.residue(takeoff.unionByName(prices)).select("tab", "field_name", "row_id")


def p2_best(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving record for each group of door or finish records."""
    return survivor.best_records((load(spark, folder, "door_records"), survivor.DOORS), (load(spark, folder, "finish_records"), survivor.FINISHES))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of two or more records of one door or room and the record to keep of each."""
    return p2_best(spark, folder).select("tab", "first_id", "keep_id")


def _remarks(spark: SparkSession, folder: str) -> DataFrame:
    scope = load(spark, folder, "scope_items").select(F.lit("scope_items").alias("tab"), F.col("scope_id").alias("id"), "text")
    lines = load(spark, folder, "takeoff_template").select(F.lit("takeoff_template").alias("tab"), F.col("item_id").alias("id"), F.col("spec_requirements").alias("text"))
    return scope.unionByName(lines)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of scope texts, and of spec requirements, that share at least 0.7 of their words."""
    return neardup.record_pairs(_remarks(spark, folder))


def p6_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Takeoff lines and the vendor rows that price them, with the confidence."""
    lines = load(spark, folder, "takeoff_template").where("list_name = 'line_items'")
    return entities.match(lines, load(spark, folder, "vendor_rows"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Takeoff lines and the vendor rows that price them."""
    return p6_matches(spark, folder).select("item_id", "row_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles that must be split and whether natural boundaries allow it."""
    return chunks.how_cut(load(spark, folder, "bundles"), "bundle_id", "full_text")


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every bundle's text."""
    return chunks.pieces(load(spark, folder, "bundles"), "bundle_id", "full_text").withColumnRenamed("key", "bundle_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokens.encode(load(spark, folder, "documents"), "doc_id", "text")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out items in documents, verbatim or paraphrased, with the cosine by which they were retrieved."""
    return leakage.leaks(load(spark, folder, "documents"), "doc_id", "text", load(spark, folder, "heldout_items"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 12 consecutive words of a held-out item."""
    rows = leakage.leaks(load(spark, folder, "documents"), "doc_id", "text", load(spark, folder, "heldout_items"), "item_id", "text", paraphrases=False)
    return rows.select("item_id", "doc_id")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of every document with the share of its sentences."""
    return subjects.subject_areas(load(spark, folder, "documents"), "doc_id", "text", load(spark, folder, "subject_labels"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects that at least a quarter of a document's sentences deal with."""
    return p10_shares(spark, folder).select("doc_id", "subject")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p2_found": p2_found, "p2_best": p2_best, "p5_found": p5_found, "p6_found": p6_found, "p6_matches": p6_matches, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_ids": p8_ids,
        "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_shares": p10_shares,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
