"""Matches of texts under units: catalogue candidates, quote rows against all cost lines, series of price indexes."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import to_places
from ..functions.text import norm_description
from .search import search, weighted_terms
from .skew import top_rows

#: Spellings of catalogue units, and the kind of measure of each.
UNIT_SPELLINGS = {
    "ea": ("ea", "each", "nr", "no", "pc", "pce", "pcs", "unit"),
    "lf": ("lf", "lin ft", "linear ft", "linft", "linear foot"),
    "m": ("m", "meter", "metre", "lm", "100 m", "1000 m"),
    "sf": ("sf", "sq ft", "sqft", "square foot", "square feet"),
    "m2": ("m2", "sqm", "sq m", "100 m2", "1000 m2", "square meter", "square metre"),
    "cy": ("cy", "cu yd", "cuyd", "cubic yard"),
    "m3": ("m3", "cu m", "cum", "cubic meter", "cubic metre", "100 m3"),
    "lb": ("lb", "lbs", "pound"),
    "kg": ("kg", "kilogram", "100 kg", "1000 kg"),
    "ton": ("ton", "tons", "short ton"),
    "t": ("t", "tonne", "metric ton", "tonnes"),
    "hr": ("hr", "hour", "hours", "labor hour", "labour hour"),
    "ls": ("ls", "lump sum", "lump"),
}
UNIT_MEASURES = {"lf": "length", "m": "length", "sf": "area", "m2": "area", "cy": "volume", "m3": "volume", "lb": "mass", "kg": "mass", "ton": "mass", "t": "mass", "ea": "count", "hr": "time", "ls": "lump"}
#: Factors for the same unit, for another unit of the same measure, for another measure; what each hint adds, at most.
SAME_UNIT, SAME_MEASURE, OTHER_MEASURE, HINT, MOST_HINT = 1.1, 0.85, 0.55, 0.015, 0.05
#: Words that hint at a division.
DIVISION_HINTS = {
    "01": ("general", "supervision", "temporary", "site management"),
    "02": ("demolition", "site preparation", "remediation"),
    "03": ("concrete", "reinforced", "rebar", "formwork", "slab", "footing"),
    "04": ("masonry", "cmu", "brick", "block"),
    "05": ("steel", "metal", "structural steel", "rebar"),
    "06": ("wood", "carpentry", "framing", "lumber", "plastic"),
    "07": ("thermal", "moisture", "insulation", "roofing", "membrane", "sealant"),
    "08": ("door", "window", "opening", "glazing", "hardware"),
    "09": ("finishes", "drywall", "gypsum", "plaster", "tile", "flooring", "paint", "ceiling"),
    "10": ("specialties", "signage", "partition", "toilet accessory"),
    "11": ("equipment", "appliance", "fixture"),
    "12": ("furnishings", "casework"),
    "13": ("special construction",),
    "14": ("conveying", "elevator", "escalator"),
    "21": ("fire", "sprinkler", "suppression"),
    "22": ("plumbing", "water", "sewer", "fixture", "pipe"),
    "23": ("hvac", "heating", "ventilation", "ductwork", "air handler"),
    "26": ("electrical", "wiring", "conduit", "luminaire", "panel"),
    "27": ("communications", "data", "cable", "fiber"),
    "28": ("security", "fire alarm", "intrusion"),
    "31": ("earthwork", "excavation", "grading", "backfill"),
    "32": ("exterior", "paving", "landscaping", "sidewalk"),
    "33": ("utilities", "water main", "sewer line", "gas line"),
}
#: Units of quotes that may stand for each other.
COMPATIBLE = (("LS", "LOT"), ("EA", "SET"), ("EA", "PR"))
#: Price series by section, by words in order, by division, and for the rest.
SECTION_SERIES = {
    "06 10 00": "WPU0811", "06 16 00": "WPU0814", "06 41 00": "WPU0812", "09 29 00": "WPU102201", "09 91 23": "WPU065", "07 31 13": "WPU1351", "07 41 13": "WPU1017", "05 12 00": "WPU101707", "05 31 00": "WPU1017", "26 05 00": "WPU102301",
    "26 24 16": "WPU102301", "22 11 00": "WPU062", "22 40 00": "WPU2025201", "03 30 00": "WPU132", "03 31 00": "WPU132", "03 35 00": "WPU132", "04 22 00": "WPU132", "32 12 16": "WPU1351", "32 13 13": "WPU132",
}
WORD_SERIES = (
    ("concrete masonry", "WPU132"), ("ready-mix concrete", "WPU132"), ("structural steel", "WPU101707"), ("plywood", "WPU0814"), ("hardwood", "WPU0812"), ("softwood", "WPU0811"), ("lumber", "WPU0811"), ("framing", "WPU0811"),
    ("drywall", "WPU102201"), ("gypsum", "WPU102201"), ("paint", "WPU065"), ("coatings", "WPU065"), ("wire", "WPU102301"), ("conduit", "WPU102301"), ("electrical", "WPU102301"), ("plumbing", "WPU2025201"), ("pvc", "WPU062"),
    ("asphalt shingle", "WPU1351"), ("asphalt", "WPU1351"), ("metal roof", "WPU1017"), ("metal deck", "WPU1017"), ("steel", "WPU1017"), ("diesel", "WPU057303"), ("fuel", "WPU057303"), ("sidewalk", "WPU132"), ("concrete", "WPU132"),
    ("insulation", "WPUSI012011"), ("hardware", "WPU2025201"),
)
DIVISION_SERIES = {
    "01": "WPUSI012011", "02": "WPUSI012011", "03": "WPU132", "04": "WPU132", "05": "WPU1017", "06": "WPU0811", "07": "WPU1351", "08": "WPU2025201", "09": "WPU102201", "10": "WPUSI012011", "11": "WPUSI012011", "12": "WPUSI012011",
    "13": "WPUSI012011", "14": "WPUSI012011", "21": "WPU102301", "22": "WPU2025201", "23": "WPUSI012011", "26": "WPU102301", "27": "WPU102301", "28": "WPU102301", "31": "WPU132", "32": "WPU132", "33": "WPU062",
}
ANY_SERIES = "WPUSI012011"


def unit_key(unit: Column) -> Column:
    """Unit of a spelling, with or without a number before it; unknown spellings stand for themselves; '' for none."""
    raw = F.trim(F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), r"\s+", " "))
    bare = F.regexp_replace(raw, r"^\d+\s*", "")
    return F.coalesce(*[F.when(raw.isin(*names) | bare.isin(*names), key) for key, names in UNIT_SPELLINGS.items()], bare)


def unit_factor(one: Column, other: Column) -> Column:
    """Factor of a similarity by the units: same unit, same measure, another measure; 1 where either is not told."""
    a, b = unit_key(one), unit_key(other)
    measures = F.create_map(*[F.lit(x) for pair in UNIT_MEASURES.items() for x in pair])
    same = F.coalesce(F.try_element_at(measures, a) == F.try_element_at(measures, b), F.lit(False))
    return F.when((a == "") | (b == ""), 1.0).when(a == b, SAME_UNIT).when(same, SAME_MEASURE).otherwise(OTHER_MEASURE)


def hint_bonus(section: Column, text: Column) -> Column:
    """What the words of a division (the first two digits of a section) in a text add to its similarity."""
    digits = F.left(F.regexp_replace(F.coalesce(section, F.lit("")), r"\D", ""), F.lit(2))
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(digits == d, sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))) for d, words in DIVISION_HINTS.items()]
    return F.least(F.lit(MOST_HINT), F.coalesce(*hits, F.lit(0)) * HINT)


def catalogue_match(wanted: DataFrame, catalogue: DataFrame, top: int = 5, first: int = 200) -> DataFrame:
    """wanted_id, place, row_id, similarity: the best catalogue rows of each wanted line.

    wanted: wanted_id, description, unit, section; catalogue: row_id, code, description, unit, category. The `first` rows by
    TF-IDF cosine (weights of the catalogue) are ranked again by cosine x unit factor + hint bonus, clamped to 0..1;
    of rows with one code, unit and description only the best counts. Wanted lines without a known term have no rows.
    """
    texts = catalogue.select(F.col("row_id").alias("id"), F.col("description").alias("text"))
    asked = wanted.select((-1 - F.col("wanted_id")).alias("id"), F.col("description").alias("text"))  # ids of their own, so that no line is taken for its own copy
    found = search(weighted_terms(texts), weighted_terms(asked, texts), first).select((-1 - F.col("query_id")).alias("wanted_id"), F.col("id").alias("row_id"), F.col("score").alias("cosine"))
    w = wanted.select("wanted_id", F.col("unit").alias("__u"), F.col("section").alias("__s"))
    pairs = found.join(w, "wanted_id").join(catalogue, "row_id")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine") * unit_factor(F.col("__u"), F.col("unit")) + hint_bonus(F.col("__s"), F.col("category"))))
    scored = pairs.select("wanted_id", "row_id", "code", "unit", "description", to_places(score, 4).alias("similarity"))
    distinct = scored.groupBy("wanted_id", "code", "unit", "description").agg(F.max(F.struct("similarity", (-F.col("row_id")).alias("minus"))).alias("b"))
    kept = distinct.select("wanted_id", (-F.col("b.minus")).alias("row_id"), F.col("b.similarity").alias("similarity"))
    return top_rows(kept, ["wanted_id"], [F.desc("similarity"), F.asc("row_id")], top, "place").select("wanted_id", "place", "row_id", "similarity")


def layered_price(lines: DataFrame, matches: DataFrame, seeds: DataFrame, least: float = 0.5) -> DataFrame:
    """wanted_id, source (catalogue, seed or none), row_id: the best match if similar enough, else the seed of the section."""
    best = matches.where("place = 1").where(F.col("similarity") >= least).select("wanted_id", F.col("row_id").alias("__match"))
    one = seeds.groupBy("section").agg(F.min("entry_id").alias("__seed"))
    joined = lines.select("wanted_id", "section").join(best, "wanted_id", "left").join(one, "section", "left")
    source = F.when(F.col("__match").isNotNull(), "catalogue").when(F.col("__seed").isNotNull(), "seed").otherwise("none")
    return joined.select("wanted_id", source.alias("source"), F.coalesce("__match", "__seed").alias("row_id"))


def units_agree(one: Column, other: Column) -> Column:
    """May rows of these canonical units be matched? Yes where either is unknown, both are equal or stand in one group."""
    grouped = F.lit(False)
    for group in COMPATIBLE:
        grouped = grouped | (one.isin(*group) & other.isin(*group))
    return one.isNull() | other.isNull() | (one == other) | grouped


def price_series(section: Column, description: Column) -> Column:
    """Price series of a line: by its section, by the first word in its description, by its division, else the general one."""
    low = F.lower(F.coalesce(description, F.lit("")))
    by_word = F.coalesce(*[F.when(low.contains(w), s) for w, s in WORD_SERIES])
    table = lambda key, t: F.try_element_at(F.create_map(*[F.lit(x) for pair in t.items() for x in pair]), key)
    return F.coalesce(table(section, SECTION_SERIES), by_word, table(F.left(section, F.lit(2)), DIVISION_SERIES), F.lit(ANY_SERIES))


def _plan_block(rows: pd.DataFrame, lines: pd.DataFrame, top: int) -> pd.DataFrame:
    """The `top` lines of each row in a block, by ratio; lines whose characters can't reach the last of them are not compared."""
    texts = list(lines["b"])
    letters = {c: i for i, c in enumerate(sorted(set("".join(texts))))}
    counts = np.zeros((len(texts), max(1, len(letters))), dtype=np.int16)
    for i, t in enumerate(texts):
        for c, n in Counter(t).items():
            counts[i, letters[c]] = n
    size = np.array([len(t) for t in texts])
    units, quantities, ids = lines["lu"].to_numpy(dtype=object), lines["lq"].to_numpy(dtype=float), lines["line_id"].to_numpy()
    alike = {u: np.array([_agree(u, v) for v in units]) for u in set(rows["u"])}
    out = []
    for r in rows.itertuples():
        own = np.zeros(counts.shape[1], dtype=np.int16)
        for c, n in Counter(r.a).items():
            if c in letters:
                own[letters[c]] = n
        near = np.abs(quantities - r.q) / np.maximum(quantities, 1e-9) <= 0.05 if r.q == r.q and r.q is not None else np.zeros(len(texts), dtype=bool)
        boost = np.where(near & (quantities > 0), 1.02, 1.0)
        bound = np.where(size + len(r.a) > 0, 2 * np.minimum(counts, own).sum(1) / np.maximum(1, size + len(r.a)), 0.0) * boost
        best: list[tuple[float, int]] = []
        matcher = SequenceMatcher(None)
        for i in np.argsort(-np.where(alike[r.u], bound, -1.0), kind="stable"):
            if not alike[r.u][i] or (len(best) == top and bound[i] < -best[-1][0] - 1e-4):
                break
            matcher.set_seqs(r.a, texts[i])
            ratio = min(1.0, round(matcher.ratio() * boost[i], 4)) if r.a and texts[i] else 0.0
            best = sorted([*best, (-ratio, int(ids[i]))])[:top]
        out += [(r.row_id, i, -s) for s, i in best]
    return pd.DataFrame(out, columns=["row_id", "line_id", "sim"])


def _agree(u: str | None, v: str | None) -> bool:
    return not u or not v or u == v or any(u in g and v in g for g in COMPATIBLE)


def match_plan(rows: DataFrame, lines: DataFrame, threshold: float = 0.75, margin: float = 0.05, top: int = 5, block: int = 4000) -> DataFrame:
    """Match plan of quote rows against every cost line whose unit agrees: status, line_id, similarity, runner_up, candidates.

    rows: row_id, description, quantity, unit; lines: line_id, description, quantity, unit (canonical units, null unknown). The
    ratio of the normalised descriptions counts 2 % more if the quantities agree within 5 %. Status: MATCHED, AMBIGUOUS
    (runner-up within the margin), LOW_SIMILARITY (no line_id), NO_MATCH (no line of an agreeing unit). Every row meets every
    block of lines, each block hands on `top` lines a row: a stated set of rows is matched against all lines, exactly.
    """
    a = rows.select("row_id", F.coalesce(norm_description(F.col("description")), F.lit("")).alias("a"), F.col("quantity").cast("double").alias("q"), F.col("unit").alias("u"))
    b = lines.select("line_id", F.coalesce(norm_description(F.col("description")), F.lit("")).alias("b"), F.col("quantity").cast("double").alias("lq"), F.col("unit").alias("lu"))
    blocks = max(1, -(-b.count() // block))
    left = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(16)).cast("int"))
    right = b.withColumn("block", F.pmod(F.xxhash64("line_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(lambda r, l: _plan_block(r, l, top), f"row_id {dict(rows.dtypes)['row_id']}, line_id bigint, sim double")
    ranked = top_rows(found, ["row_id"], [F.desc("sim"), F.asc("line_id")], top)
    ranked = ranked.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sim", "line_id"))).alias("found"))  # at most `top`
    best, second = F.col("found")[0], F.coalesce(F.try_element_at("found", F.lit(2))["sim"], F.lit(0.0))
    status = F.when(F.col("found").isNull(), "NO_MATCH").when(best["sim"] < threshold, "LOW_SIMILARITY").when((F.size("found") > 1) & (best["sim"] - second < margin), "AMBIGUOUS").otherwise("MATCHED")
    return a.select("row_id").join(ranked, "row_id", "left").select(
        "row_id", status.alias("status"), F.when(best["sim"] >= threshold, best["line_id"]).alias("line_id"), best["sim"].alias("similarity"), second.alias("runner_up"),
        F.coalesce(F.col("found.line_id"), F.array().cast("array<bigint>")).alias("candidates"),
    )
