"""Queries of facts out of texts and of table imports, with their SQL checks.

Where no test table holds such texts, the query runs over the literal cases below, and its SQL holds the answers that
the rules give when they are followed by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, lines, measures
from ..operators import alternates, imports
from ..sources.tables import load
from .registry import Registry

_REGISTRY = Registry()
query, queries, oracle_sql = _REGISTRY.query, _REGISTRY.queries, _REGISTRY.oracle_sql


def _sql_literal(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"{v!r}::double" if isinstance(v, float) else str(v)


def answers(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows."""
    return "select * from (values " + ", ".join("(" + ", ".join(map(_sql_literal, r)) + ")" for r in rows) + f") t({columns})"


_TITLE_PAGES = [
    (1, 'PROJECT NAME: North Lab  SHEET NO: A-101\nPROJECT NO. - 22-118\nSHEET TITLE: First Floor Plan\nSCALE: 1/8" = 1\'-0"\nDATE: 3/4/2024\nDRAWN BY: KL', "22-118", "North Lab", "A-101", "First Floor Plan", "Architectural", 1 / 96),
    (2, "JOB NO: 7\nPROJECT : Annex\nSHEET # M2.1\nSCALE - 1:50\nREVISION: 2", "7", "Annex", "M2.1", None, "Mechanical", 0.02),
    (3, 'SHEET NUMBER FP3\nSCALE: 1" = 20\'\nSHEET TITLE:   ', None, None, "FP3", None, "Fire Protection", 1 / 240), (4, "nothing here", None, None, None, None, None, None), (5, "SCALE: as noted", None, None, None, None, None, None),
]


@query(answers("page_id, project_number, project_name, sheet_number, sheet_title, discipline, scale_factor", [(p[0], *p[2:7], None if p[7] is None else round(p[7], 6)) for p in _TITLE_PAGES]))
def title_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([p[:2] for p in _TITLE_PAGES], "page_id int, text string").withColumn("b", facts.title_block(F.col("text")))
    return rows.select("page_id", "b.project_number", "b.project_name", "b.sheet_number", "b.sheet_title", "b.discipline", F.round("b.scale_factor", 6).alias("scale_factor"))


_DIMENSION_PAGES = [(1, "Wall 10'-6 1/2\" by 6 1/2\" thick, pipe 100 mm, span 12.5' and 0\" gap"), (2, "2 m x 50 cm; 3' - 4\"; 6000' out"), (3, None), (4, "7.5\"")]
_DIMENSIONS = [(1, "feet-inches", 126.5), (1, "metric", 3.937008), (1, "decimal-feet", 150.0), (1, "feet-inches", 6.5), (2, "metric", 78.740157), (2, "metric", 19.685039), (2, "feet-inches", 40.0), (4, "feet-inches", 7.5)]


@query(answers("page_id, kind, inches", _DIMENSIONS))
def page_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    found = facts.dimensions(spark.createDataFrame(_DIMENSION_PAGES, "page_id int, text string"), "page_id", "text")
    return found.select("page_id", "kind", F.round("inches", 6).alias("inches"))


@query("""
with f as (select bundle_id, regexp_extract_all(coalesce(full_text, ''), '\\b[A-Z]{1,3}-?[0-9]{1,3}(?:\\.[0-9]{1,2})?\\b') a from bundles)
select bundle_id, case when len(a) = 0 then '' else regexp_extract(a[-1], '^([A-Z]{1,3})', 1) || '-' || regexp_extract(a[-1], '([0-9.]+)$', 1) end sheet from f
""")
def last_sheet_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "bundles").select("bundle_id", F.coalesce(facts.sheet_number(F.coalesce("full_text", F.lit(""))), F.lit("")).alias("sheet"))


_SHEET_KINDS = (
    "REFLECTED CEILING > reflected_ceiling, ROOF PLAN > roof_plan, SITE PLAN > site_plan, DEMOLITION > demolition, FOUNDATION PLAN > foundation_plan, FRAMING PLAN > framing_plan, MECHANICAL PLAN > mechanical_plan, ELECTRICAL PLAN > electrical_plan, "
    "PLUMBING PLAN > plumbing_plan, STRUCTURAL PLAN > structural_plan, RISER > riser_diagram, SINGLE LINE > single_line_diagram, ELEVATION > elevation, SECTION > section, ENLARGED > enlarged_plan, DETAIL > detail, SCHEDULE > schedule, "
    "SPECIFICATION > specification, GENERAL NOTES > general_notes, INDEX > index, COVER > cover, FLOOR PLAN > floor_plan"
)


@query(f"""
with t as (select bundle_id, upper(concat_ws(' ', title_hint, left(full_text, 500))) h from bundles)
select bundle_id, case {" ".join("when contains(h, '" + w + "') then '" + k + "'" for w, k in (x.split(" > ") for x in _SHEET_KINDS.split(", ")))} end kind from t
""")
def sheet_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "bundles").select("bundle_id", facts.sheet_kind(F.col("title_hint"), F.col("full_text")).alias("kind"))


_TITLES = "FLOOR PLAN|ROOF PLAN|SITE PLAN|FOUNDATION PLAN|FRAMING PLAN|REFLECTED CEILING|ELEVATION|SECTION|SCHEDULE|DETAIL|ENLARGED PLAN|DEMOLITION|ELECTRICAL PLAN|MECHANICAL PLAN|PLUMBING PLAN|RISER DIAGRAM|SINGLE LINE"


@query(f"""
select bundle_id, list_filter(list_transform(regexp_split_to_array(full_text, '[\\r\\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) between 1 and 79 and regexp_matches(upper(x), '{_TITLES}'))[1] title from bundles
""")
def title_lines(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "bundles").select("bundle_id", lines.title_line(F.col("full_text")).alias("title"))


_TEXT_CASES = [
    ("subtotal", "Subtotal", "true"), ("subtotal", "SUB-TOTAL:", "true"), ("subtotal", "Total replacement of subfloor", "false"), ("subtotal", "Total: 12,345", "true"), ("subtotal", "Freight = 9", "true"), ("subtotal", "Shipping", "true"), ("subtotal", "Handling", "true"),
    ("subtotal", "sum", "false"), ("subtotal", "Tax-exempt purchasing", "false"), ("subtotal", "balance", "false"), ("robot", "<p>Are you a robot?</p>", "true"), ("robot", "<p>Concrete</p>", "false"), ("robot", "Pardon Our Interruption", "true"),
    ("fuel", "natural gas fired", "GAS"), ("fuel", "hot water coil", "HW"), ("fuel", "elec. reheat", "ELECTRIC"), ("fuel", "steam", None), ("refrigerant", "charged with R-410a", "R-410A"), ("refrigerant", "R 32 unit", "R-32"), ("refrigerant", "none", None),
    ("emergency", "EM/EMER ballast", "true"), ("emergency", "with battery backup", "true"), ("emergency", "EMERGE only", None), ("emergency", "demand", None), ("scale", '1/4" = 1\'-0"', "0.020833"), ("scale", "1:100", "0.01"), ("scale", "NTS", None),
    ("period", "Q1 2026 cost report", "2026-Q1"), ("period", "released in April 2026", "2026-04"), ("period", "no date", "2024-03"), ("series", "OEUM001910000000047203104", "0019100/47-2031/04"), ("series", "CEU123", None),
    ("alternates", "See Bid Alternates below", "true"), ("alternates", "Option 001 adds paving", "true"), ("alternates", "optional work", "false"), ("type", "VE item: delete trim", "VE"), ("type", "Use LVT in lieu of VCT, deduct", "SUBSTITUTION"),
    ("type", "Omit canopy", "DEDUCTIVE"), ("type", "Include awning", "ADDITIVE"), ("type", "Paving", "ADDITIVE"), ("photo", "for reference only", "true"), ("photo", "plan", "false"),
    ("placeholders", "a {{ x }} and {{y z}}", "x|y z"), ("items", "- one\n* two\ntext", "one|two"), ("headings", "# T\n## A\nbody a\n## B\n", "A=body a|B="), ("clean", " North Lab  SHEET NO: A1", "North Lab"),
    ("dollars", "$3.2M", "3200000.0"), ("dollars", "about $750K", "750000.0"), ("dollars", "$1,234.50", "1234.5"), ("alternate id", "Alt #1", "Alternate 1"), ("alternate id", "Alternate No. 1", "Alternate 1"),
]


@query(answers("case_no, kind, answer", [(i, k, a) for i, (k, _, a) in enumerate(_TEXT_CASES)]))
def text_facts(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(_TEXT_CASES)], "case_no int, kind string, text string")
    t = F.col("text")
    series = facts.series_parts(t)
    parts = facts.headed_blocks(t)
    kinds = {
        "subtotal": lines.is_subtotal(t), "robot": facts.is_robot_check(t), "fuel": facts.fuel(t), "refrigerant": facts.refrigerant(t), "emergency": facts.is_emergency(t), "scale": F.round(facts.scale_factor(t), 6),
        "period": facts.period_or(measures.period(t), F.lit("2024-03-09").cast("date")), "series": F.concat_ws("/", series["area"], series["soc"], series["datatype"]), "alternates": alternates.tells_alternates(t), "type": alternates.alternate_type(t),
        "photo": facts.is_reference_photo(t, F.array(F.lit(0.1), F.lit(0.7))), "placeholders": F.array_join(facts.placeholders(t), "|"), "items": F.array_join(facts.list_items(t), "|"),
        "headings": F.array_join(F.transform(parts, lambda p: F.concat(p["heading"], F.lit("="), p["body"])), "|"), "clean": facts.clean_field(t), "dollars": measures.dollars(t), "alternate id": measures.alternate_id(t),
    }
    return rows.select("case_no", "kind", F.nullif(F.coalesce(*[F.when(F.col("kind") == k, c.cast("string")) for k, c in kinds.items()]), F.lit("")).alias("answer"))


@query("""
select line_id, coalesce('$' || format('{:,.2f}', total_cost), '') shown, case when total_cost is null then '$_____' when total_cost = 0 then '$0.00' when total_cost > 0 then '+$' || format('{:,.2f}', total_cost) else '-$' || format('{:,.2f}', -total_cost) end delta
from price_sheet where total_cost is null or abs(total_cost * 1000 - floor(total_cost * 1000) - 0.5) > 0.01
""")
def money_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts to the cent as reports show them; the check leaves out values halfway between cents, which the two engines round apart."""
    rows = load(spark, folder, "price_sheet").where("total_cost is null or abs(total_cost * 1000 - floor(total_cost * 1000) - 0.5) > 0.01")
    return rows.select("line_id", facts.money(F.col("total_cost")).alias("shown"), facts.delta_text(F.col("total_cost")).alias("delta"))


_SHEETS = [
    ("q.xlsx", "Doors", 1, [["Quote 77", None], ["Item", "Qty", "UOM", "Unit Price", "Notes"], ["Hollow metal door", "4", "EA", "$1,200.00", "lead 6 wks"], ["", None, "", "", ""], ["Subtotal", "", "", "4800", ""], [None, "2", "EA", "5", ""], ["Frame", "x", "EA", "abc", ""]]),
    ("q.xlsx", "Paint", 2, [["Description", "Quantity", "Extended"], ["Paint walls", "200", "$500.00"], ["Paint ceiling", "0", "100"], ["Total:", "", "600"], ["Prime", "10", "(5)"]]), ("q.xlsx", "Cover", 3, [["hello"], ["world"]]),
]
_SHEET_SCHEMA = "file string, sheet string, sheet_no int, cells array<array<string>>"


@query(
    answers(
        "sheet, row_no, description, quantity, unit_cost, reason",
        [("Doors", 3, "Hollow metal door", 4.0, 1200.0, None), ("Doors", 6, None, 2.0, 5.0, "description"), ("Doors", 7, "Frame", None, None, "number"), ("Paint", 2, "Paint walls", 200.0, 2.5, None), ("Paint", 3, "Paint ceiling", 0.0, None, "number"), ("Paint", 5, "Prime", 10.0, -0.5, "number")],
    )
)
def sheet_imports(spark: SparkSession, folder: str) -> DataFrame:
    return imports.sheet_rows(spark.createDataFrame(_SHEETS, _SHEET_SCHEMA)).select("sheet", "row_no", "description", "quantity", "unit_cost", "reason")


@query(answers("row_index, description, notes", [(2, "Hollow metal door", "Doors :: row 3 :: lead 6 wks"), (3, "Paint walls", "Paint :: row 2")]))
def sheets_merged(spark: SparkSession, folder: str) -> DataFrame:
    return imports.merged_sheets(imports.sheet_rows(spark.createDataFrame(_SHEETS, _SHEET_SCHEMA))).select("row_index", "description", "notes")


_REPLIES = [
    ("a", 1, '{"is_quote_page": true, "vendor": " ", "line_items": [{"description": "Slab", "quantity": 2, "unit": "CY", "unit_cost": 150.5}, {"description": "", "unit_cost": 1}, {"description": "Rebar", "unit_cost": -3}]}'),
    ("a", 2, '{"is_quote_page": false, "line_items": [{"description": "skip", "unit_cost": 1}]}'), ("a", 3, "not json"), ("a", 4, '{"vendor": "Acme", "quote_ref": "Q7", "line_items": [{"description": "Mesh", "unit_cost": 4}]}'), ("b", 1, None),
]
_REPLY_SCHEMA = "doc string, page int, reply string"


@query(answers("doc, page, row_index, description, quantity, unit, unit_cost", [("a", 1, 2, "Slab", 2.0, "CY", 150.5), ("a", 4, 5, "Mesh", None, None, 4.0)]))
def reply_imports(spark: SparkSession, folder: str) -> DataFrame:
    return imports.reply_rows(spark.createDataFrame(_REPLIES, _REPLY_SCHEMA), "doc", "page", "reply")


@query(answers("doc, vendor, quote_ref, n_pages, n_used, confidence", [("a", "Acme", "Q7", 4, 2, 0.5), ("b", None, None, 1, 0, 0.0)]))
def reply_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return imports.reply_summary(spark.createDataFrame(_REPLIES, _REPLY_SCHEMA), "doc", "page", "reply")


_PRICE_FILES = [('{"_meta": {"unit": "x", "unit_cost": 1}, "03 30 00": {"description": "Slab", "unit": "CY", "unit_cost": 150}, "09 91 23": {"description": "Paint", "unit": "SF"}, "08 11 13": {"unit": " ", "unit_cost": 9}}',), ("broken",), (None,)]


@query(answers("section, description, unit, unit_cost", [("03 30 00", "Slab", "CY", 150.0)]))
def keyed_prices(spark: SparkSession, folder: str) -> DataFrame:
    return imports.keyed_prices(spark.createDataFrame(_PRICE_FILES, "text string"), "text")


@query("""
select p_partkey::varchar code, p_name description, p_type unit, p_retailprice::double unit_price, 0.0::double labor_cost, 0.0::double material_cost, 0.0::double equipment_cost from part where trim(p_name) <> ''
""")
def catalogue_table(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as a price catalogue under other column names."""
    rows = load(spark, folder, "part").select(F.col("p_partkey").alias("item_code"), F.col("p_name").alias("NAME"), F.col("p_type").alias("UOM"), F.col("p_retailprice").alias("Price"), F.lit("x").alias("other"))
    return imports.catalogue_rows(rows)


_ALTERNATE_LINES = [
    (1, 1, "ALTERNATES SECTION"), (1, 2, "Alternate No. 1: Provide terrazzo at the main lobby   $12,500.00"), (1, 3, "Deduct Alternate 2 - Delete canopy ($3,000.00)"), (1, 4, "Alt #3: Substitute LVT for VCT  $____"), (1, 5, "no alternates apply"), (2, 1, None),
]


@query(answers("doc, line_no, alternate_type, cost_delta", [(1, 2, "ADDITIVE", 12500.0), (1, 3, "DEDUCTIVE", -3000.0), (1, 4, "SUBSTITUTION", None)]))
def alternates_parse(spark: SparkSession, folder: str) -> DataFrame:
    found = alternates.from_lines(spark.createDataFrame(_ALTERNATE_LINES, "doc int, line_no int, line string"), "doc", "line_no", "line")
    return found.select("doc", "line_no", "alternate_type", "cost_delta")
