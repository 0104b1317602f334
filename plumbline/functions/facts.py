"""Facts out of texts of sheets, feeds and schedules: title blocks, dimensions, scales, flags, periods, ids, formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measures import sheet_discipline

#: Labelled fields of title blocks (without case), the first pattern of a field that is found counts.
TITLE_BLOCK = (
    ("project_number", r"PROJECT\s+NO\.?\s*[:\-]\s*([^\n\r]+)"),
    ("project_number", r"PROJECT\s+#\s*[:\-]?\s*([^\n\r]+)"),
    ("project_number", r"\bJOB\s+NO\.?\s*[:\-]\s*([^\n\r]+)"),
    ("project_name", r"PROJECT(?:\s+NAME)?\s*[:\-]\s*([^\n\r]+)"),
    ("sheet_number", r"SHEET\s+(?:NO\.?|NUMBER|#)\s*[:\-]?\s*([A-Z]{1,3}[-]?\d+(?:\.\d+)?[A-Z]?)"),
    ("sheet_title", r"SHEET\s+TITLE\s*[:\-]\s*([^\n\r]+)"),
    ("scale", r"\bSCALE\s*[:\-]\s*([^\n\r]+)"),
    ("date", r"\bDATE\s*[:\-]\s*([^\n\r]+)"),
    ("revision", r"REVISION\s*[:\-]\s*([^\n\r]+)"),
    ("revision", r"\bREV\.?\s+NO\.?\s*[:\-]\s*([^\n\r]+)"),
    ("drawn_by", r"DRAWN\s+BY\s*[:\-]\s*([^\n\r]+)"),
    ("checked_by", r"CHECKED\s+BY\s*[:\-]\s*([^\n\r]+)"),
)
#: Words of titles and of the first 500 characters by kind of sheet, in the order in which they are tried.
SHEET_WORDS = (
    ("REFLECTED CEILING", "reflected_ceiling"), ("ROOF PLAN", "roof_plan"), ("SITE PLAN", "site_plan"), ("DEMOLITION", "demolition"), ("FOUNDATION PLAN", "foundation_plan"), ("FRAMING PLAN", "framing_plan"),
    ("MECHANICAL PLAN", "mechanical_plan"), ("ELECTRICAL PLAN", "electrical_plan"), ("PLUMBING PLAN", "plumbing_plan"), ("STRUCTURAL PLAN", "structural_plan"), ("RISER", "riser_diagram"), ("SINGLE LINE", "single_line_diagram"),
    ("ELEVATION", "elevation"), ("SECTION", "section"), ("ENLARGED", "enlarged_plan"), ("DETAIL", "detail"), ("SCHEDULE", "schedule"), ("SPECIFICATION", "specification"), ("GENERAL NOTES", "general_notes"), ("INDEX", "index"),
    ("COVER", "cover"), ("FLOOR PLAN", "floor_plan"),
)
#: Fuels by the words that tell them.
FUELS = ((("HOT WATER", "HW"), "HW"), (("NATURAL GAS", "GAS", "NG", "LPG", "PROPANE"), "GAS"), (("ELECTRIC", "ELEC"), "ELECTRIC"))
#: Words of emergency fixtures.
EMERGENCY = ("EMERG", "EMERGENCY", "BATTERY BACKUP", "BATT BACKUP", "EMER", "EM/EMER", "EM")
#: Most inches of a dimension.
MOST_INCHES = 5000.0


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def clean_field(text: Column) -> Column:
    """A field's text up to the next label in capitals, blanks evened out, without outer blanks and separators; null if nothing is left."""
    cut = F.regexp_replace(F.trim(text), r"\s{2,}[A-Z][A-Z ]{2,}\s*[:\-](?s:.*)$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(cut, r"\s+", " "), r"^[ :\-,;]+|[ :\-,;]+$", ""), F.lit(""))


def title_block(text: Column) -> Column:
    """Struct of the fields of a title block, with the discipline of the sheet number and the factor of the scale."""
    found: dict[str, list[Column]] = {}
    for name, pattern in TITLE_BLOCK:
        found.setdefault(name, []).append(clean_field(_first(text, "(?i)" + pattern)))
    fields = {name: F.coalesce(*columns) for name, columns in found.items()}
    return F.struct(*[c.alias(n) for n, c in fields.items()], sheet_discipline(fields["sheet_number"]).alias("discipline"), scale_factor(fields["scale"]).alias("scale_factor"))


def scale_factor(text: Column) -> Column:
    """Inches on paper for an inch in the world: 1/4" = 1'-0", 1" = 20', 1:100; null for what can't be read."""
    number = lambda c: c.try_cast("double")
    frac = r"(\d+)\s*/\s*(\d+)\s*\"\s*=\s*(\d+)\s*'(?:\s*-?\s*(\d+)\s*\")?"
    top, bottom, feet, inches = (number(_first(text, frac, i)) for i in (1, 2, 3, 4))
    real = feet * 12 + F.coalesce(inches, F.lit(0.0))
    whole = r"(\d+(?:\.\d+)?)\s*\"\s*=\s*(\d+(?:\.\d+)?)\s*'"
    paper, far = (number(_first(text, whole, i)) for i in (1, 2))
    metric = number(_first(text, r"\b1\s*:\s*(\d+)\b"))
    zero = F.lit(0.0)
    return F.when(top.isNotNull(), top / F.nullif(bottom, zero) / F.nullif(real, zero)).when(paper.isNotNull(), paper / F.nullif(far * 12, zero)).otherwise(1 / F.nullif(metric, zero))


def sheet_number(text: Column) -> Column:
    """The last sheet number of a page's text as A-101, with or without a dash there: title blocks stand at the end."""
    pattern = r"\b([A-Z]{1,3})[-]?(\d{1,3}(?:\.\d{1,2})?)\b"
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1))
    return F.concat_ws("-", F.when(last.isNotNull(), F.regexp_extract(last, pattern, 1)), F.when(last.isNotNull(), F.regexp_extract(last, pattern, 2)))


def sheet_kind(title: Column, text: Column) -> Column:
    """Kind of a sheet by its title and the first 500 characters of its text; null if no word tells."""
    hay = F.upper(F.concat_ws(" ", title, F.left(text, F.lit(500))))
    return F.coalesce(*[F.when(hay.contains(w), kind) for w, kind in SHEET_WORDS])


def _whole_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"(?<![A-Z])(?:" + "|".join(words) + r")(?![A-Z])")


def is_emergency(*texts: Column) -> Column:
    """True where a text has a word of emergency fixtures, null elsewhere (silence is no no)."""
    return F.when(_whole_word(F.upper(F.concat_ws(" ", *texts)), EMERGENCY), True)


def refrigerant(*texts: Column) -> Column:
    """R-410A and the like."""
    return F.concat(F.lit("R-"), F.upper(_first(F.concat_ws(" ", *texts), r"(?i)\bR\s*-?\s*(\d{2,4}[A-Z]?)\b")))


def fuel(*texts: Column) -> Column:
    blob = F.upper(F.concat_ws(" ", *texts))
    return F.coalesce(*[F.when(blob.rlike(r"\b(?:" + "|".join(words) + r")\b"), kind) for words, kind in FUELS])


def series_id(area: Column, occupation: Column, datatype: str = "04") -> Column:
    """Fixed-width id of a wage series: OEUM, 7 digits of the area, 6 zeros, 6 of the occupation, 2 of the kind."""
    return F.concat(F.lit("OEUM"), area, F.lit("000000"), F.replace(occupation, F.lit("-"), F.lit("")), F.lit(datatype))


def series_parts(series: Column) -> Column:
    """Struct of area, industry, occupation, soc, datatype of such an id, null for anything else."""
    part = lambda at, n: F.substring(series, at, n)
    fields = F.struct(part(5, 7).alias("area"), part(12, 6).alias("industry"), part(18, 6).alias("occupation"), F.concat_ws("-", part(18, 2), part(20, 4)).alias("soc"), part(24, 2).alias("datatype"))
    return F.when(series.startswith("OEUM") & (F.length(series) >= 25), fields)


def period_or(period: Column, day: Column, quarterly: bool = False) -> Column:
    """The period, or the month or quarter of a day."""
    usual = F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")) if quarterly else F.date_format(day, "yyyy-MM")
    return F.coalesce(period, usual)


def money(amount: Column) -> Column:
    """$1,234.50; empty for null."""
    return F.coalesce(F.when(amount < 0, F.concat(F.lit("$-"), F.format_number(F.abs(amount), 2))).otherwise(F.concat(F.lit("$"), F.format_number(amount, 2))), F.lit(""))


def signed_money(amount: Column) -> Column:
    """+$1,234.50 or -$1,234.50; null stays null."""
    return F.concat(F.when(amount >= 0, "+$").otherwise("-$"), F.format_number(F.abs(amount), 2))


def delta_text(amount: Column) -> Column:
    """As signed_money, $0.00 without a sign, `$_____` for null."""
    return F.when(amount.isNull(), "$_____").when(amount == 0, "$0.00").otherwise(signed_money(amount))


def _dimension(kind: str, pattern: str) -> Callable[[Column], Column]:
    """From a match of a pattern the struct of kind, raw text and inches."""

    def read(raw: Column) -> Column:
        number = lambda i: _first(raw, pattern, i).try_cast("double")
        if kind == "metric":
            unit = F.lower(_first(raw, pattern, 2))
            inches = F.when(unit == "mm", number(1) / 25.4).when(unit == "cm", number(1) / 2.54).otherwise(number(1) * 39.3700787)
        elif kind == "decimal-feet":
            inches = number(1) * 12
        else:
            at = 2 if kind == "feet-inches" else 1
            share = F.coalesce(number(at + 1) / F.nullif(number(at + 2), F.lit(0.0)), F.lit(0.0))
            decimal = F.coalesce(F.concat(F.lit("0."), _first(raw, pattern, at + 3)).try_cast("double"), F.lit(0.0))
            inches = (number(1) * 12 if at == 2 else F.lit(0.0)) + number(at) + share + decimal
        return F.struct(F.lit("feet-inches" if kind == "inches" else kind).alias("kind"), raw.alias("raw"), inches.alias("inches"))

    return read


def dimensions(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Dimensions written on pages: key, kind, raw, inches.

    Feet with inches are taken first, then metric, feet alone, inches alone; what one pattern took is blanked for the next.
    Nothing of 0 inches or more than MOST_INCHES.
    """
    inch = r"(\d+)(?:\s+(\d+)/(\d+))?\s*(?:\.(\d+))?\s*\""
    steps = [
        ("feet-inches", r"(\d+)\s*'\s*-?\s*" + inch), ("metric", r"(?i)(\d+(?:\.\d+)?)\s*(mm|cm|m)\b"), ("decimal-feet", r"(?<![\d\.])(\d+(?:\.\d+)?)\s*'(?!')"),
        ("inches", r"(?<![\d\.])(\d+)(?:\s+(\d+)/(\d+))?(?:\.(\d+))?\s*\""),
    ]
    rest, found = F.col(text), []
    for kind, pattern in steps:
        found.append(F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), _dimension(kind, pattern)))
        rest = F.regexp_replace(rest, pattern, "\u0001")
    rows = pages.select(key, F.explode(F.concat(*found)).alias("d"))
    return rows.select(key, "d.*").where((F.col("inches") > 0) & (F.col("inches") <= MOST_INCHES))


def headed_blocks(text: Column, level: int = 2) -> Column:
    """Blocks of a markdown text under its headings of a level: array of heading, body (trimmed)."""
    mark = "#" * level + " "
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), rf"\n{mark}"), F.lit(2), F.lit(10_000))
    return F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("heading"), F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body")))


def list_items(text: Column) -> Column:
    """Items of markdown lists, dashes and stars alike."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(r"\n\s*[-*]\s+([^\n]+)"), F.lit(1))


def placeholders(text: Column) -> Column:
    """Names in {{...}}, in order."""
    return F.regexp_extract_all(text, F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), F.lit(1))


#: What pages of robot checks say (in lower case).
ROBOT_CHECKS = (
    "pardon our interruption",
    "/_incapsula_resource",
    "as you were browsing, something about your browser",
    "request unsuccessful. incapsula",
    "access denied",
    "bot detected",
    "captcha verification",
    "akamai-edgesuite",
    "we want to make sure you're a real person",
    "are you a robot",
)


def is_robot_check(html: Column) -> Column:
    low = F.lower(html)
    found = low.contains(ROBOT_CHECKS[0])
    for w in ROBOT_CHECKS[1:]:
        found = found | low.contains(w)
    return F.coalesce(found, F.lit(False))


def is_reference_photo(text: Column, ratios: Column, phrase: str = "REFERENCE ONLY", least: float = 0.6) -> Column:
    """A page that says `phrase` and has an image over more than `least` of its area."""
    return F.coalesce(F.upper(text).contains(phrase.upper()) & F.exists(ratios, lambda r: r > least), F.lit(False))
