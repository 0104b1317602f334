"""Facts from lines of text: titles, subtotals, labelled values, wage rates, index values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of drawing titles.
TITLE_WORDS = (
    "FLOOR PLAN", "ROOF PLAN", "SITE PLAN", "FOUNDATION PLAN", "FRAMING PLAN", "REFLECTED CEILING", "ELEVATION", "SECTION", "SCHEDULE", "DETAIL", "ENLARGED PLAN", "DEMOLITION",
    "ELECTRICAL PLAN", "MECHANICAL PLAN", "PLUMBING PLAN", "RISER DIAGRAM", "SINGLE LINE",
)
#: What makes a row a subtotal.
SUBTOTALS = ("subtotal", "sub total", "sub-total", "grand total", "total", "tax", "sales tax", "shipping", "freight", "handling")


def title_line(text: Column) -> Column:
    """First line of less than 80 characters that has a word of drawing titles; null if none."""
    lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & (F.length(x) < 80))
    return F.try_element_at(F.filter(lines, lambda x: F.upper(x).rlike("|".join(TITLE_WORDS))), F.lit(1))


def is_subtotal(text: Column) -> Column:
    """A row whose text is a subtotal word, or starts with one before a colon or equals sign."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s:=]+", " "), r"\s+", " "))
    words = "|".join(SUBTOTALS)
    return F.coalesce(F.regexp_replace(plain, "[:= ]+$", "").isin(*SUBTOTALS) | plain.rlike(rf"^(?:{words})(?: ?:| =)"), F.lit(False))


def after_label(text: Column, label: str) -> Column:
    """Rest of the first line that starts with `label` and a colon; null if none or blank."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*{label}\s*:\s*(.*?)\s*$", 1)), F.lit(""))


def index_value(text: Column, anchor: str, least: float, most: float, window: int = 600) -> Column:
    """First number within bounds, years left out, in the `window` characters after `anchor`."""
    at = F.instr(F.lower(text), anchor.lower())
    near = F.when(at > 0, F.substring(text, at + len(anchor), F.lit(window)))
    numbers = F.transform(F.regexp_extract_all(near, F.lit(r"(?<![0-9.,])([0-9][0-9,]*(?:\.[0-9]+)?)(?![0-9])"), F.lit(1)), lambda n: F.struct(F.replace(n, F.lit(","), F.lit("")).try_cast("double").alias("v"), n.rlike(r"^(19|20)[0-9]{2}$").alias("year")))
    return F.try_element_at(F.filter(numbers, lambda n: n["v"].between(least, most) & ~n["year"]), F.lit(1))["v"]


def wage_rates(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """Rates of wage tables in text: doc, line_no, trade, base, fringe, rate.

    A line is a trade of letters and two or three amounts: base, fringe and, if given, their total, which then is the rate.
    """
    lines = pages.select(doc, F.posexplode(F.split(text, r"[\r\n]+")).alias("line_no", "line"))
    amounts = F.transform(F.regexp_extract_all("line", F.lit(r"\$?\s*([0-9]+\.[0-9]{2})\b"), F.lit(1)), lambda a: a.try_cast("double"))
    trade = F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s*([A-Za-z][A-Za-z ,/&()-]+?)\s*[.…]*\s*\$?\s*[0-9]+\.[0-9]{2}", 1), r"[.\s]+$", ""))
    found = lines.withColumn("a", amounts).withColumn("trade", trade).where((F.size("a") >= 1) & (F.col("trade") != ""))
    base, fringe, total = (F.try_element_at("a", F.lit(i)) for i in (1, 2, 3))
    return found.select(doc, "line_no", "trade", base.alias("base"), fringe.alias("fringe"), F.round(F.coalesce(total, base + fringe, base), 2).alias("rate"))


def lenient(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Fields of JSON texts by `schema`; what can't be read is null, no row is lost."""
    return df.withColumn("__j", F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})).select(*[F.col(c) for c in df.columns if c != text], "__j.*")
