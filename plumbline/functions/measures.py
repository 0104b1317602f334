"""Typed values out of measures, prices, periods and codes written as text. No match gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    return F.nullif(F.replace(text, F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def feet_inches(text: Column) -> Column:
    """Inches of feet-and-inches (3'-0", 3 ft 5 3/4 in), of inches alone or of feet alone."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "[’′]", "'"), "[”″]|''", '"')
    feet = _number(_group(t, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:'|ft\.?|feet|foot)"))
    rest = F.regexp_replace(t, r"^\s*[0-9]+(?:\.[0-9]+)?\s*(?:'|ft\.?|feet|foot)\s*-?\s*", "")
    whole = _number(_group(rest, r"^([0-9]+(?:\.[0-9]+)?)(?:\s+[0-9]+/[0-9]+)?\s*(?:\"|in\b|in\.|inch)"))
    top, bottom = _number(_group(rest, r"^[0-9]+\s+([0-9]+)/[0-9]+")), _number(_group(rest, r"^[0-9]+\s+[0-9]+/([0-9]+)"))
    part = F.coalesce(top / F.nullif(bottom, F.lit(0.0)), F.lit(0.0))
    inches = F.when(whole.isNotNull(), whole + part)
    return F.when(feet.isNotNull() | inches.isNotNull(), F.coalesce(feet * 12, F.lit(0.0)) + F.coalesce(inches, F.lit(0.0)))


def ceiling_feet(text: Column) -> Column:
    """Feet of a ceiling height; a bare number up to 30 is feet."""
    bare = _number(_group(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*$"))
    return F.coalesce(feet_inches(text) / 12, F.when(bare <= 30, bare))


def area(text: Column) -> Column:
    """The first number, thousands commas allowed, of a text that is an area (SF, sq ft, or bare)."""
    return _number(_group(text, r"^\s*~?\s*(?:approx\.?\s*)?\[?([0-9][0-9,]*(?:\.[0-9]+)?)\]?\s*(?:(?i:sf|sq\.?\s*ft\.?|square feet)\b.*)?$"))


def quantity_before(text: Column, units: str) -> Column:
    """The number directly before one of the units (a regular expression, compared without case)."""
    return _number(_group(text, rf"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:{units})\b"))


def voltage(text: Column) -> Column:
    """Highest line voltage of 120, 480/3, 208V/3."""
    return F.array_max(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]{3})"), F.lit(1)), lambda v: v.try_cast("int")), lambda v: v.between(100, 600)))


def phases(text: Column) -> Column:
    return _group(text, r"/\s*([13])(?:\s*(?:φ|ph|PH))?\s*$").try_cast("int")


def cost_delta(text: Column) -> Column:
    """Signed amount of a price line: needs $ or USD; parentheses are negative; a blank `$____` is null."""
    blank = text.rlike(r"\$\s*_{2,}")
    amount = F.coalesce(_number(_group(text, r"\$\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)")), _number(_group(text, r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)\s+(?i:usd)\b")))
    negative = text.rlike(r"\(\s*\$\s*[0-9][0-9,]*(?:\.[0-9]{1,2})?\s*\)")
    return F.when(~blank, F.when(negative, -amount).otherwise(amount))


def dollars(text: Column, least: float = 0.0, most: float = 1e12) -> Column:
    """$1,234.50, $3.2M, $750K as a number within bounds."""
    number = _number(_group(text, r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)"))
    scale = F.lower(F.regexp_extract(text, r"\$\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*([KkMmBb])(?:\b|illion)", 1))
    value = number * F.when(scale == "k", 1e3).when(scale == "m", 1e6).when(scale == "b", 1e9).otherwise(1.0)
    return F.when(value.between(least, most), value)


#: Month names by number.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def period(text: Column) -> Column:
    """YYYY-MM or YYYY-QN of `March 2024`, `2024-03`, `Q1 2024`, `1st quarter 2024`."""
    low = F.lower(text)
    iso = _group(low, r"\b((?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2]))\b")
    quarter = F.coalesce(
        F.concat(_group(low, r"\bq[1-4][ ,]+((?:19|20)[0-9]{2})"), F.lit("-Q"), _group(low, r"\bq([1-4])[ ,]+(?:19|20)[0-9]{2}")),
        F.concat(_group(low, r"\b[1-4](?:st|nd|rd|th) quarter,? ((?:19|20)[0-9]{2})"), F.lit("-Q"), _group(low, r"\b([1-4])(?:st|nd|rd|th) quarter,? (?:19|20)[0-9]{2}")),
    )
    names = "|".join(m[:3] for m in MONTHS)
    name = _group(low, rf"\b({names})[a-z]*\.?,? (?:19|20)[0-9]{{2}}")
    month = F.concat(_group(low, rf"\b(?:{names})[a-z]*\.?,? ((?:19|20)[0-9]{{2}})"), F.lit("-"), F.lpad((F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name)).cast("string"), 2, "0"))
    return F.coalesce(iso, quarter, month)


def finish_code(text: Column) -> Column:
    """Struct of category and variant of a finish code like VCT-1."""
    up = F.upper(F.trim(text))
    return F.when(up.rlike(r"^[A-Z]{1,5}[- ]?[0-9]*$"), F.struct(F.regexp_extract(up, r"^([A-Z]+)", 1).alias("category"), F.regexp_extract(up, r"([0-9]*)$", 1).alias("variant")))


def sheet_discipline(sheet: Column) -> Column:
    """Discipline of a sheet number by its letters, two before one."""
    letters = F.regexp_extract(F.upper(sheet), r"^([A-Z]{1,2})", 1)
    table = F.create_map(*[F.lit(x) for pair in DISCIPLINES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, letters), F.try_element_at(table, F.left(letters, F.lit(1))))


#: Disciplines by sheet prefix.
DISCIPLINES = {
    "A": "Architectural",
    "I": "Interior",
    "S": "Structural",
    "M": "Mechanical",
    "E": "Electrical",
    "P": "Plumbing",
    "C": "Civil",
    "L": "Landscape",
    "F": "Fire Protection",
    "FP": "Fire Protection",
    "T": "Telecom",
    "G": "General",
}


def alternate_id(text: Column) -> Column:
    """`Alt #1`, `Alternate No. 1` and `ALT-1` alike as `Alternate 1`; VE, Bid, Add, Deduct and Option keep their family."""
    low = F.lower(text)
    token = F.upper(F.regexp_extract(low, r"(?:alternates?|alt|ve(?: item)?|option)\.?\s*(?:-|#|no\.?|number)?\s*([a-z0-9][a-z0-9.-]*)", 1))
    family = (
        F.when(low.rlike(r"^\s*ve\b"), "VE-").when(low.rlike(r"\bbid alternate"), "Bid Alternate ").when(low.rlike(r"\badd(itive)? alt"), "Add Alternate ")
        .when(low.rlike(r"\bdeduct(ive)? alt"), "Deduct Alternate ").when(low.rlike(r"\boption\b"), "Option ").otherwise("Alternate ")
    )
    return F.when(token != "", F.concat(family, token))
