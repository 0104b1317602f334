"""Imports of tables out of sheets, quotes, replies and catalogues: header detection, row checks, merges with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import is_subtotal
from ..functions.rounding import to_places
from ..functions.text import norm

#: Names that columns of vendor tables go by.
COLUMN_NAMES = {
    "description": ("description", "item description", "item", "scope", "line item", "desc", "work description"),
    "quantity": ("quantity", "qty", "qnty", "count"),
    "unit_of_measure": ("unit of measure", "uom", "u m", "unit", "units"),
    "unit_cost": ("unit cost", "unit price", "price", "rate", "cost", "cost each", "price each"),
    "extended": ("extended", "extended price", "extended cost", "amount", "total", "total price", "line total", "ext"),
    "vendor": ("vendor", "supplier", "subcontractor", "company"),
    "quote_ref": ("quote ref", "quote", "quote no", "quote number", "reference", "ref"),
    "notes": ("notes", "note", "remarks", "comments"),
}
#: Rows at the top of a sheet among which its header is looked for, and least columns a header names.
HEADER_ROWS, HEADER_COLUMNS = 10, 2


def column_of(cell: Column) -> Column:
    """Column that a header cell names, null if none."""
    name = norm(cell)
    return F.coalesce(*[F.when(name.isin(*names), column) for column, names in COLUMN_NAMES.items()])


def header_row(rows: Column) -> Column:
    """Place (from 0) of the first of the top rows that names at least HEADER_COLUMNS columns, description among them; null if none."""
    def fits(cells: Column) -> Column:
        named = F.array_distinct(F.filter(F.transform(cells, column_of), lambda c: c.isNotNull()))
        return F.array_contains(named, "description") & (F.size(named) >= HEADER_COLUMNS)

    top = F.slice(rows, 1, HEADER_ROWS)
    return F.nullif(F.array_position(F.transform(top, fits), F.lit(True)), F.lit(0)) - 1


def number(text: Column) -> Column:
    """Number of a cell: $, thousands commas, blanks; parentheses are negative; null for anything else."""
    bare = F.regexp_replace(text, r"[\s$,]", "")
    inner = F.regexp_extract(bare, r"^\((.*)\)$", 1)
    return F.when(inner != "", -inner.try_cast("double")).otherwise(F.when(bare.rlike(r"^-?[0-9]*\.?[0-9]+$"), bare.try_cast("double")))


def sheet_rows(sheets: DataFrame) -> DataFrame:
    """Rows of sheets (file, sheet, sheet_no, cells array<array<string>>) under the sheet's own header: file, sheet, sheet_no, row_no
    (from 1, of the sheet), the columns of COLUMN_NAMES, reason (why a row fails: description or number; null for good ones).

    Sheets without a header give no rows, blank rows neither. A unit cost that is missing is the extended amount over the
    quantity (4 places). Subtotals are left out.
    """
    found = sheets.withColumn("header", header_row(F.col("cells"))).where("header is not null")
    named = found.withColumn("names", F.transform(F.get("cells", F.col("header").cast("int")), column_of))
    rows = named.select("file", "sheet", "sheet_no", "names", "header", F.posexplode("cells").alias("at", "row")).where("at > header")
    rows = rows.where(F.exists("row", lambda c: F.coalesce(F.trim(c) != "", F.lit(False))))
    value = lambda c: F.nullif(F.trim(F.get("row", (F.array_position("names", c) - 1).cast("int"))), F.lit(""))
    told = rows.select("file", "sheet", "sheet_no", (F.col("at") + 1).alias("row_no"), *[F.when(F.array_contains("names", c), value(c)).alias(c) for c in COLUMN_NAMES])
    quantity = number(F.col("quantity"))
    quantity = F.when(quantity >= 0, quantity)
    derived = to_places(number(F.col("extended")) / F.nullif(quantity, F.lit(0.0)), 4)
    cost = F.coalesce(number(F.col("unit_cost")), derived)
    told = told.withColumn("cost", cost).withColumn("q", quantity).where(~is_subtotal(F.col("description")))
    reason = F.when(F.col("description").isNull(), "description").when(F.col("cost").isNull() | (F.col("cost") < 0), "number")
    return told.select("file", "sheet", "sheet_no", "row_no", "description", F.col("q").alias("quantity"), "unit_of_measure", F.col("cost").alias("unit_cost"), "vendor", "quote_ref", "notes", reason.alias("reason"))


def merged_sheets(rows: DataFrame, separator: str = " :: ") -> DataFrame:
    """Good rows of a file's sheets as one table, numbered from 2 in the order of sheets and rows, their place told first in the notes."""
    good = rows.where("reason is null")
    place = F.concat_ws(separator, "sheet", F.concat(F.lit("row "), F.col("row_no").cast("string")), F.nullif(F.trim("notes"), F.lit("")))
    order = Window.partitionBy("file").orderBy("sheet_no", "row_no")  # of one file
    return good.withColumn("notes", place).withColumn("row_index", F.row_number().over(order) + 1).drop("reason", "sheet", "sheet_no", "row_no")


#: Schema of a page's reply.
REPLY = "is_quote_page boolean, vendor string, quote_ref string, line_items array<struct<description: string, quantity: double, unit: string, unit_cost: double>>"


def reply_rows(pages: DataFrame, doc: str, page: str, reply: str) -> DataFrame:
    """Rows out of JSON replies, page by page: doc, page, row_index (from 2), description, quantity, unit, unit_cost.

    Replies that can't be read, of other pages, and items without a description or with a negative or missing cost give no row.
    """
    read = pages.select(doc, page, F.from_json(F.col(reply), REPLY, {"mode": "PERMISSIVE"}).alias("r")).where(F.coalesce(F.col("r.is_quote_page"), F.lit(True)))
    items = read.select(doc, page, F.posexplode("r.line_items").alias("at", "i"))
    order = Window.partitionBy(doc).orderBy(page, "at")  # of one document
    numbered = items.withColumn("row_index", F.row_number().over(order) + 1)
    return numbered.where((F.trim("i.description") != "") & (F.col("i.unit_cost") >= 0)).select(doc, page, "row_index", "i.*")


def reply_summary(pages: DataFrame, doc: str, page: str, reply: str) -> DataFrame:
    """One row a document: the first vendor and quote told, pages, pages with rows, confidence (their share, 4 places)."""
    read = pages.select(doc, page, F.from_json(F.col(reply), REPLY, {"mode": "PERMISSIVE"}).alias("r"))
    told = read.groupBy(doc).agg(
        F.min_by("r.vendor", F.when(F.trim("r.vendor") != "", F.col(page))).alias("vendor"), F.min_by("r.quote_ref", F.when(F.trim("r.quote_ref") != "", F.col(page))).alias("quote_ref"), F.count(F.lit(1)).alias("n_pages")
    )
    used = reply_rows(pages, doc, page, reply).groupBy(doc).agg(F.countDistinct(page).alias("n_used"))
    return told.join(used, doc, "left").select(doc, "vendor", "quote_ref", "n_pages", F.coalesce("n_used", F.lit(0)).alias("n_used"), to_places(F.coalesce("n_used", F.lit(0)) / F.col("n_pages"), 4).alias("confidence"))


def keyed_prices(texts: DataFrame, text: str) -> DataFrame:
    """Entries of price files that are JSON objects keyed by section: section, description, unit, unit_cost.

    Keys that begin with an underscore and entries without a unit or a unit cost are left out, files that can't be read too.
    """
    entries = texts.select(F.explode(F.map_entries(F.from_json(F.col(text), "map<string, struct<description: string, unit: string, unit_cost: double>>"))).alias("e"))
    return entries.where(~F.col("e.key").startswith("_") & (F.trim("e.value.unit") != "") & F.col("e.value.unit_cost").isNotNull()).select(F.col("e.key").alias("section"), "e.value.*")


#: Names that columns of catalogues go by, the first that is there counts.
CATALOGUE_NAMES = {
    "code": ("code", "item_code", "rate_code", "id"), "description": ("description", "desc", "name", "rate_name"), "unit": ("unit", "uom", "measure"),
    "unit_price": ("unit_price", "price", "total_cost", "cost"), "labor_cost": ("labor_cost", "labour_cost"), "material_cost": ("material_cost",), "equipment_cost": ("equipment_cost", "machinery_cost"),
}


def catalogue_rows(df: DataFrame) -> DataFrame:
    """A catalogue table under its usual names: code, description, unit, unit_price, labor_cost, material_cost, equipment_cost.

    A missing column is null, a cost that can't be read 0; rows without a description are left out.
    """
    known = {c.lower(): c for c in df.columns}
    pick = lambda names: next((F.col(f"`{known[n]}`") for n in names if n in known), F.lit(None))
    texts = [F.nullif(F.trim(pick(CATALOGUE_NAMES[c]).cast("string")), F.lit("")).alias(c) for c in ("code", "description", "unit")]
    costs = [F.coalesce(pick(names).cast("string").try_cast("double"), F.lit(0.0)).alias(c) for c, names in CATALOGUE_NAMES.items() if c not in ("code", "description", "unit")]
    return df.select(*texts, *costs).where("description is not null")
