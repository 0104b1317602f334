"""Bid alternates out of text and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures
from ..functions.text import norm
from .classify import first_match
from .families import has_any

#: Tokens after `Alternate` that are headings, not ids.
NOT_IDS = (
    "SECTION", "SCHEDULE", "FORM", "PAGE", "NOTE", "NOTES", "ITEM", "ITEMS", "ALTERNATE", "ALTERNATES", "ALTERNATIVE", "ALTERNATIVES", "PRICING", "PRICE", "PROPOSAL", "PROPOSALS", "BID", "BIDS", "TABLE", "LIST",
    "REQUEST", "REQUESTS", "OPTION", "OPTIONS", "ADDITION", "ADDITIONS", "DEDUCTION", "DEDUCTIONS", "DESCRIPTION", "DESC", "AMOUNT", "AMOUNTS", "TOTAL", "TOTALS", "QUANTITY", "UNIT", "BIDDER", "OFFEROR", "RESPONDENT",
)
#: Words by the type they tell, in the order in which they are tried.
TYPE_WORDS = (
    ("VE", ("value engineering", "value-engineering", "ve item", "ve-item", "ve proposal")),
    ("SUBSTITUTION", ("substitute", "substitution", "alternate to", "in lieu of", "swap", "replace with")),
    ("DEDUCTIVE", ("deduct", "deductive", "omit", "delete", "remove", "savings", "credit")),
    ("ADDITIVE", ("add", "additive", "additional", "include")),
)
#: Words that tell a page of alternates.
SECTION_WORDS = (
    "bid alternate", "bid alternates", "add alternate", "deduct alternate", "deductive alternate", "additive alternate", "alternates", "alternative bid", "alternative bids", "alternative pricing", "alternate pricing",
    "alternate proposal", "alternate price", "alternate item", "alternate add", "alternate deduct", "voluntary alternate", "voluntary alternates", "schedule of alternates", "section 01220", "section 01 22 00",
    "section 01 23 00", "01 23 00 - alternates", "01 22 00 - alternates", "option no", "clin option", "value engineering", "ve item", "ve items", "ve alternate", "ve alternates", "ve proposal", "substitution alternate",
    "alternate no.", "alternate #", "alt #", "alt no.",
)
SECTION_PATTERNS = (r"\boption\s+(?:no\.?\s*)?\d", r"\bclin\s+(?:option|alt)")
LINE = r"(?i)^\s*(?:(?:add|deduct|deductive|additive|substitution)\s+)?(?:bid\s+alternates?|alternates?|alt|ve\s+item|ve)\b\.?[\s:#-]*(?:no\.?|number|#)?\s*([A-Za-z0-9][A-Za-z0-9.-]*)\s*[:.)\-–—]?\s*(.*)$"


def alternate_type(text: Column) -> Column:
    """VE, SUBSTITUTION, DEDUCTIVE or ADDITIVE by the words of a line, in this order; ADDITIVE without any."""
    low = F.lower(text)
    return first_match([(has_any(low, words), kind) for kind, words in TYPE_WORDS], "ADDITIVE")


def tells_alternates(text: Column) -> Column:
    """Does a page speak of bid alternates?"""
    low = F.lower(text)
    found = has_any(low, SECTION_WORDS)
    for p in SECTION_PATTERNS:
        found = found | low.rlike(p)
    return F.coalesce(found, F.lit(False))


def signed(amount: Column, kind: Column) -> Column:
    """Savings are negative: deductive and VE amounts lose their sign to minus."""
    return F.when(kind.isin("DEDUCTIVE", "VE"), -F.abs(amount)).otherwise(amount)


def from_lines(lines: DataFrame, doc: str, line_no: str, text: str) -> DataFrame:
    """Alternates of documents' lines: doc, line_no, alternate_id, alternate_type, description, cost_delta, confidence."""
    kind = alternate_type(F.col(text))
    token = F.upper(F.regexp_extract(text, LINE, 1))
    found = lines.where(F.col(text).rlike(LINE)).withColumn("token", token)
    found = found.where(~F.col("token").isin(*NOT_IDS) & (F.col("token").rlike("[0-9]") | F.col("token").rlike("^[A-Z]$") | (F.length("token") >= 2)))
    delta = signed(measures.cost_delta(F.col(text)), kind)
    body = F.trim(F.regexp_replace(F.regexp_extract(text, LINE, 2), r"[\s.$_]*\(?\$?[\s_]*[0-9,.]*\)?\s*(?i:add|deduct)?\s*$", ""))
    sure = F.lit(0.55) + F.when(delta.isNotNull(), 0.2).otherwise(0.0) + F.when(F.lower(text).rlike("add|deduct|substitut|ve"), 0.1).otherwise(0.0) + F.when(F.length(body) >= 25, 0.05).otherwise(0.0)
    return found.select(doc, line_no, measures.alternate_id(F.regexp_extract(text, r"^(.{0,60})", 1)).alias("alternate_id"), kind.alias("alternate_type"), body.alias("description"), delta.alias("cost_delta"), F.round(F.least(F.lit(0.95), sure), 2).alias("confidence"))


def reconcile(found: DataFrame, order: str) -> DataFrame:
    """One row per normalised id: the most complete (amount, description, confidence), missing amounts filled from the others; rows without an id stay."""
    keyed = found.withColumn("key", norm(F.col("alternate_id")))
    named = keyed.where("key <> ''")
    filled = F.col("cost_delta").isNotNull().cast("int") + (F.coalesce(F.col("description"), F.lit("")) != "").cast("int")
    rest = [c for c in found.columns]
    best = named.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(filled, "confidence", (-F.col(order)))).alias("b"), F.min_by("cost_delta", F.when(F.col("cost_delta").isNotNull(), F.col(order))).alias("any_delta"))
    merged = best.select(*[F.col(f"b.{c}").alias(c) if c != "cost_delta" else F.coalesce("b.cost_delta", "any_delta").alias(c) for c in rest])
    return merged.unionByName(keyed.where("key is null or key = ''").select(*rest))
