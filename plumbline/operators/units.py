"""Quantities recorded in different units, brought to common ones.

A unit column is looked up in a broadcast table of aliases (a fixed number of rows). Where the unit stands
only in text, an automaton over all aliases finds every one of them in a single pass; the longest match at a
place wins, and the words around it decide whether it is the unit of the field or belongs to some other
measure in the text. The factors are joined afterwards, as for unit columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import need

_FOOT_M = 0.3048
_GALLON_L = 3.785411784
_POUND_KG = 0.45359237
_BTU_H_W = 0.29307107
_CFM_M3S = _FOOT_M**3 / 60  # cubic metres a second in one CFM
_GPM_LS = _GALLON_L / 60  # litres a second in one GPM

#: Fixed values. For each family its common unit and, by factor to it, the spellings (compared without case,
#: trailing points and repeated blanks).
FAMILIES: dict[str, list[tuple[str, float, tuple[str, ...]]]] = {
    "material": [
        ("LF", 1.0, ("lf", "l.f", "lft", "lin ft", "lin. ft", "linear feet", "linear foot", "ft", "feet", "foot")),
        ("LF", 100.0, ("clf", "c.l.f", "hundred lf", "hundred linear feet")),
        ("LF", 3.0, ("yd", "yds", "yard", "yards", "lin yd", "linear yards", "ly")),
        ("LF", 1 / _FOOT_M, ("m", "lm", "lin m", "meter", "meters", "metre", "metres", "linear meters", "linear metres")),
        ("LF", 1 / 12, ("in", "inch", "inches")),
        ("SF", 1.0, ("sf", "s.f", "sqft", "sq ft", "sq. ft", "square feet", "square foot", "ft2", "ft²")),
        ("SF", 100.0, ("csf", "hundred sf", "hundred sq ft", "sq", "squares", "square", "sq (roofing)", "roofing squares")),
        ("SF", 1000.0, ("msf", "thousand sf", "thousand sq ft")),
        ("SF", 9.0, ("sy", "sq yd", "sq. yd", "sq yds", "sq. yds", "square yards", "square yard", "yd2", "yd²")),
        ("SF", 1 / _FOOT_M**2, ("m2", "m²", "sqm", "sq m", "sq. m", "sq metres", "sq. metres", "sq meters", "square meters", "square metres")),
        ("CY", 1.0, ("cy", "c.y", "cu yd", "cu. yd", "cubic yards", "cubic yard", "yd3", "yd³")),
        ("CY", 1 / 27, ("cf", "c.f", "cu ft", "cu. ft", "cubic feet", "cubic foot", "ft3", "ft³")),
        ("CY", 1 / (27 * _FOOT_M**3), ("m3", "m³", "cu m", "cu. m", "cubic metres", "cubic meters", "cum")),
        ("LB", 1.0, ("lb", "lbs", "pound", "pounds")),
        ("LB", 100.0, ("cwt", "hundredweight")),
        ("LB", 2000.0, ("ton", "tons", "tn", "short ton", "short tons")),
        ("LB", 1 / _POUND_KG, ("kg", "kgs", "kilogram", "kilograms")),
        ("LB", 1000 / _POUND_KG, ("tonne", "tonnes", "metric ton", "metric tons", "mt")),
        ("EA", 1.0, ("ea", "each", "pc", "pcs", "piece", "pieces", "ea (units)", "units", "unit", "no", "nos")),
        ("EA", 12.0, ("dz", "doz", "dozen")),
        ("EA", 144.0, ("grs", "gross", "gr")),
        ("EA", 100.0, ("hundred", "per 100", "/100", "per hundred")),
        ("EA", 1000.0, ("thousand", "per 1000", "/1000", "per thousand", "per 1,000")),
        ("GAL", 1.0, ("gal", "gals", "gallon", "gallons")),
        ("GAL", 1 / _GALLON_L, ("l", "ltr", "ltrs", "liter", "liters", "litre", "litres")),
    ],
    "air": [
        ("CFM", 1.0, ("cfm", "c.f.m", "cu ft/min", "ft3/min", "ft³/min")),
        ("CFM", 0.001 / _CFM_M3S, ("l/s", "lps", "litres/s", "liters/s")),
        ("CFM", 1 / _CFM_M3S, ("m3/s", "m³/s", "cms")),
        ("CFM", 1 / (3600 * _CFM_M3S), ("m3/h", "m³/h", "cmh", "m3/hr", "m³/hr")),
    ],
    "water": [
        ("GPM", 1.0, ("gpm", "us gpm", "gal/min", "g.p.m")),
        ("GPM", 1 / _GPM_LS, ("l/s", "lps", "litres/s", "liters/s")),
        ("GPM", 1 / (60 * _GPM_LS), ("lpm", "l/min", "l.p.m")),
        ("GPM", 1 / (3.6 * _GPM_LS), ("m3/h", "m³/h", "cmh", "m3/hr", "m³/hr")),
        ("GPM", 1000 / _GPM_LS, ("m3/s", "m³/s", "cms")),
    ],
    "heat": [
        ("MBH", 1.0, ("mbh", "kbtu/h", "kbtuh", "kbtu/hr")),
        ("MBH", 1000.0, ("mmbtu/h", "mmbtuh", "mmbtu/hr")),
        ("MBH", 0.001, ("btu/h", "btuh", "btu/hr")),
        ("MBH", 1 / _BTU_H_W, ("kw", "kilowatt", "kilowatts")),
        ("MBH", 0.001 / _BTU_H_W, ("w", "watts")),
        ("MBH", 12.0, ("tr", "ton", "tons", "tons of cooling", "tons of refrigeration")),
    ],
    "width": [
        ("IN", 1.0, ('"', "″", "”", "''", "in", "inch", "inches")),
        ("IN", 12.0, ("'", "’", "′", "ft", "foot", "feet")),
        ("IN", 0.1 / (_FOOT_M / 12 * 100), ("mm",)),
        ("IN", 1 / (_FOOT_M / 12 * 100), ("cm",)),
        ("IN", 100 / (_FOOT_M / 12 * 100), ("m", "meter", "meters", "metre", "metres")),
    ],
}

#: Which family measures the capacity of an equipment type.
EQUIPMENT_FAMILY = {"AHU": "air", "VAV": "air", "FAN": "air", "PUMP": "water", "CHILLER": "heat", "BOILER": "heat", "RTU": "heat"}

#: What stands directly before a unit that is told for the field itself.
CUES = (
    "uom =", "uom:", "uom", "unit =", "unit:", "(unit:", "units:", "in", "by", "figures are", "numbers", "numbers are", "values are",
    "column is", "reads", "rated", "quantity is", "capacity is", "measured",
)


def normal_unit(unit: Column) -> Column:
    """A unit as the alias table spells it: lower case, single blanks, no outer blanks or trailing points."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(unit)), r"\s+", " "), r"[.\s]+$", "")


def alias_rows() -> list[tuple[str, str, str, float]]:
    """(family, alias, common unit, factor): the conversion table, a fixed number of rows."""
    return [(family, a, unit, factor) for family, rows in FAMILIES.items() for unit, factor, aliases in rows for a in aliases]


def conversion_table(spark: SparkSession) -> DataFrame:
    """The table to broadcast; its size is fixed by FAMILIES."""
    return spark.createDataFrame(alias_rows(), "family string, alias string, unit string, factor double")


class Finder:
    """An Aho-Corasick automaton over the aliases of one family."""

    def __init__(self, family: str) -> None:
        import ahocorasick

        self.factor = {a: f for fam, a, _, f in alias_rows() if fam == family}
        self.unit = {a: u for fam, a, u, _ in alias_rows() if fam == family}
        self.automaton = ahocorasick.Automaton()
        for alias in self.factor:
            self.automaton.add_word(alias, alias)
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, alias) of whole-word matches in lower-case `text`, of overlapping ones the longest."""
        found = []
        for last, alias in self.automaton.iter(text):
            start, end = last - len(alias) + 1, last + 1
            before, after = text[start - 1 : start], text[end : end + 1]
            if alias[0].isalnum() and before.isalpha() or alias[-1].isalnum() and after.isalnum():
                continue
            found.append((start, end, alias))
        found.sort(key=lambda m: (m[0], m[0] - m[1]))
        kept: list[tuple[int, int, str]] = []
        for m in found:
            if not kept or m[0] >= kept[-1][1]:
                kept.append(m)
            elif m[1] - m[0] > kept[-1][1] - kept[-1][0]:
                kept[-1] = m
        return kept

    def told(self, text: str | None) -> str | None:
        """The alias that `text` tells for its field: the last one with a cue before it (or `at design` after it)
        that isn't the unit of a number in the text."""
        if not text:
            return None
        low = re.sub(r"\s+", " ", text.lower())
        best = None
        for start, end, alias in self.matches(low):
            lead = low[:start].rstrip()
            if lead[-1:].isdigit():
                continue
            after = low[end:].lstrip()
            cue = any(lead.endswith(c) and (len(lead) == len(c) or not lead[-len(c) - 1].isalnum()) for c in CUES)
            if cue or lead.endswith("(") and after.startswith("at "):
                best = alias
        return best

    _PART = re.compile(r"(\d+(?:\.\d+)?)(?:\s+(\d+)/(\d+))?|(\d+)/(\d+)")

    def measure(self, text: str | None) -> tuple[float | None, bool]:
        """Sum of the number-unit parts of a raw measure in the common unit, and whether any part is in another unit.
        (None, False) unless the whole text consists of such parts."""
        if not text or not text.strip():
            return None, False
        low = re.sub(r"\s+", " ", text.lower()).strip()
        at, total, other = 0, 0.0, False
        while at < len(low):
            number = self._PART.match(low, at)
            if not number or number[5] and not int(number[5]) or number[3] and not int(number[3]):
                return None, False
            value = float(number[1]) if number[1] else int(number[4]) / int(number[5])
            if number[3]:
                value += int(number[2]) / int(number[3])
            at = number.end()
            while low[at : at + 1] == " ":
                at += 1
            alias = max((a for a in self.factor if low.startswith(a, at)), key=len, default=None)
            if alias is None:
                return None, False
            at += len(alias)
            if low[at : at + 1].isalpha():
                return None, False
            total += value * self.factor[alias]
            other |= self.factor[alias] != 1.0
            while low[at : at + 1] in (" ", "-", ".") and at < len(low):
                at += 1
        return total, other


@lru_cache(maxsize=None)
def finder(family: str) -> Finder:
    return Finder(family)


@F.pandas_udf(T.StringType())
def told_unit(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Alias told in the first or else the second text for a field of the family in the third column."""
    for first, second, family in batches:
        yield pd.Series([
            (finder(f).told(a) or finder(f).told(b)) if f in FAMILIES else None for a, b, f in zip(first, second, family)
        ], dtype=object)


@F.pandas_udf(T.DoubleType())
def raw_width_inches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Inches of a raw width that isn't in inches alone; null for widths in inches, bare numbers and anything else."""
    for raw in batches:
        codes, values = pd.factorize(raw, use_na_sentinel=True)
        inches = [v if other else None for v, other in map(finder("width").measure, values)]
        yield pd.Series([inches[c] if c >= 0 else None for c in codes], dtype="float64")


def _converted(rows: DataFrame, tab: str, conversions: DataFrame) -> DataFrame:
    """rows: row_id, family, value, unit_text, text_1, text_2. A told unit is sought only where unit_text is null or blank."""
    rows = rows.where("value is not null and not isnan(value)").withColumn("given", F.nullif(normal_unit(F.col("unit_text")), F.lit("")))
    by_column = rows.where("given is not null").select("row_id", "family", "value", F.col("given").alias("alias"))
    by_text = (
        rows.where("given is null and (text_1 is not null or text_2 is not null)")
        .withColumn("alias", told_unit("text_1", "text_2", "family"))
        .select("row_id", "family", "value", "alias")
    )
    # the conversion table has a fixed number of rows (FAMILIES)
    joined = by_column.unionByName(by_text).join(F.broadcast(conversions), ["family", "alias"])
    return joined.where("factor <> 1").select(F.lit(tab).alias("tab"), "row_id", "unit", (F.col("value") * F.col("factor")).alias("qty"))


def common_units(takeoff: DataFrame | None = None, vendor: DataFrame | None = None, hvac: DataFrame | None = None, doors: DataFrame | None = None) -> DataFrame:
    """Values whose recorded unit differs in size from the common one: tab, row_id, unit, qty (in the common unit).

    Null values, units we don't know (lump sums, lots, times, pairs, sets, ...) and capacities in a unit that
    doesn't fit the equipment give no row; a value in another spelling of the common unit gives none either.
    The unit column rules; where it is null or blank, a unit told in notes, else in the description, does.
    A bare width has no unit. Ids may repeat: each row is taken by itself. Empty tables give no rows.
    """
    parts = []
    if takeoff is not None:
        rows = need(takeoff, "item_id", "quantity", "unit", "notes", "description")
        rows = rows.select(F.col("item_id").alias("row_id"), F.lit("material").alias("family"), F.col("quantity").alias("value"), F.col("unit").alias("unit_text"), F.col("notes").alias("text_1"), F.col("description").alias("text_2"))
        parts.append((rows, "takeoff_template"))
    if vendor is not None:
        rows = need(vendor, "row_id", "quantity", "unit_of_measure", "notes", "description")
        rows = rows.select("row_id", F.lit("material").alias("family"), F.col("quantity").alias("value"), F.col("unit_of_measure").alias("unit_text"), F.col("notes").alias("text_1"), F.col("description").alias("text_2"))
        parts.append((rows, "vendor_rows"))
    if hvac is not None:
        family = F.coalesce(*[F.when(F.upper(F.trim("equipment_type")) == kind, F.lit(name)) for kind, name in EQUIPMENT_FAMILY.items()])
        rows = need(hvac, "record_id", "equipment_type", "capacity_value", "capacity_unit", "notes", "description")
        rows = rows.select(F.col("record_id").alias("row_id"), family.alias("family"), F.col("capacity_value").alias("value"), F.col("capacity_unit").alias("unit_text"), F.col("notes").alias("text_1"), F.col("description").alias("text_2"))
        parts.append((rows, "hvac_records"))
    result = None
    for rows, tab in parts:
        part = _converted(rows, tab, conversion_table(rows.sparkSession))
        result = part if result is None else result.unionByName(part)
    if doors is not None:
        rows = need(doors, "record_id", "width_raw").where("width_raw is not null")
        part = rows.select(F.lit("door_records").alias("tab"), F.col("record_id").alias("row_id"), F.lit("IN").alias("unit"), raw_width_inches("width_raw").alias("qty")).where("qty is not null")
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("give at least one table")
    return result
