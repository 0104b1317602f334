"""Joins: tiered lookups, as-of joins, conditional anti-joins, fuzzy joins and geometry back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import to_places
from ..functions.similarity import cosine
from ..functions.text import norm_description
from .skew import top_rows

#: A side is broadcast only below this many rows, counted first.
BROADCAST_ROWS = 20_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if a count, stopped at `most`, shows that it is small; unchanged otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tiered_lookup(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry of each item: by section, else the one of its division with most of its words, else any with a word.

    items: item_id, section, division, description; entries: entry_id, section, division, words. Ties go to the
    smallest entry_id. Result: item_id, entry_id, tier (section, division, any; null without a match). Words are
    joined by equality, so no pair is compared that shares nothing; words of items are distinct.
    """
    listed = small_side(entries)
    exact = items.join(listed.groupBy("section").agg(F.min("entry_id").alias("exact")), "section", "left").select("item_id", "division", "description", "exact")
    open_items = exact.where("exact is null").select("item_id", F.col("division").alias("item_division"), F.explode(F.array_distinct(F.split(norm_description(F.col("description")), " "))).alias("word"))
    posted = listed.select("entry_id", F.col("division").alias("entry_division"), F.explode(F.array_distinct("words")).alias("word"))
    hits = open_items.join(posted, "word").groupBy("item_id", "entry_id").agg(F.count(F.lit(1)).alias("hits"), F.max(F.col("item_division").eqNullSafe(F.col("entry_division"))).alias("same"))
    best = hits.groupBy("item_id").agg(
        F.max(F.when(F.col("same"), F.struct("hits", (-F.col("entry_id")).alias("minus"))))["minus"].alias("near"),
        F.min("entry_id").alias("any"),
    )
    joined = exact.select("item_id", "exact").join(best, "item_id", "left")
    tier = F.when(F.col("exact").isNotNull(), "section").when(F.col("near").isNotNull(), "division").when(F.col("any").isNotNull(), "any")
    return joined.select("item_id", F.coalesce("exact", -F.col("near"), "any").alias("entry_id"), tier.alias("tier"))


def as_of(series: DataFrame, wanted: DataFrame) -> DataFrame:
    """Value of a series at a period: that of the period, else of the last one before, else the oldest (flagged late).

    series: series, period, value; wanted: series, at. One row per wanted pair: series, at, period, value, late.
    """
    pairs = wanted.select("series", "at").distinct().join(series, "series", "left")
    before = F.col("period") <= F.col("at")
    picked = pairs.groupBy("series", "at").agg(
        F.max(F.when(before, F.struct("period", "value"))).alias("asof"), F.min(F.when(F.col("period").isNotNull(), F.struct("period", "value"))).alias("oldest")
    )
    return picked.select("series", "at", F.coalesce("asof", "oldest").alias("p"), F.col("asof").isNull().alias("late")).select("series", "at", "p.period", "p.value", "late")


def change_factor(series: DataFrame, wanted: DataFrame, fallback: str | None = None) -> DataFrame:
    """series, base, target, factor: value at target over value at base (4 places), 1.0 where either is missing or zero.

    A wanted series without any value takes those of `fallback`.
    """
    if fallback is not None:
        known = series.select("series").distinct().withColumn("__known", F.lit(True))
        asked = wanted.join(known, "series", "left").withColumn("__used", F.when(F.col("__known"), F.col("series")).otherwise(F.lit(fallback)))
        factors = change_factor(series, asked.select(F.col("__used").alias("series"), "base", "target")).withColumnRenamed("series", "__used")
        return asked.join(factors, ["__used", "base", "target"]).select("series", "base", "target", "factor")
    base = as_of(series, wanted.select("series", F.col("base").alias("at"))).select("series", F.col("at").alias("base"), F.col("value").alias("v0"))
    target = as_of(series, wanted.select("series", F.col("target").alias("at"))).select("series", F.col("at").alias("target"), F.col("value").alias("v1"))
    both = wanted.select("series", "base", "target").distinct().join(base, ["series", "base"], "left").join(target, ["series", "target"], "left")
    return both.select("series", "base", "target", F.coalesce(to_places(F.col("v1") / F.nullif(F.col("v0"), F.lit(0.0)), 4), F.lit(1.0)).alias("factor"))


def retire_covered(rows: DataFrame, made: DataFrame, row_id: str, owner: str, text: str, mark: str) -> DataFrame:
    """`rows` without those whose text names, as a whole token, a mark that `made` has for the same owner.

    The tokens of a text are joined with the longest token of each mark (marks of two characters or more) by
    equality, then the whole mark is looked for, so the anti-join needs no comparison of every pair.
    """
    parts = F.filter(F.split(F.lower(mark), "[^a-z0-9]+"), lambda t: t != "")
    longest = F.array_max(F.transform(parts, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    marks = made.where(F.length(mark) >= 2).select(F.col(owner).alias("__owner"), F.lower(mark).alias("__mark"), longest.alias("__token")).distinct()
    tokens = rows.select(row_id, F.col(owner).alias("__owner"), F.col(text).alias("__text"), F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("__token"))
    whole = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("__mark"), F.lit(r"\E(?![a-z0-9])"))
    covered = tokens.join(marks, ["__owner", "__token"]).where(F.regexp_like(F.lower("__text"), whole)).select(row_id).distinct()
    return rows.join(covered, row_id, "left_anti")


#: For each family the column of its section and what it starts with, whether a description alone may tell the
#: family, and the rows of whole aggregates that made rows replace.
FAMILIES = {
    "door": ("csi_division", ("08",), False, r"^(hollow\s+metal|solid[\-\s]?core\s+wood|wood|steel|aluminum|glass)\s+doors?(\s*:?\s*\d+\s+ea)?\s*$|^doors?\s*\(type\s+unspecified\)\s*$"),
    "window": ("csi_section", ("08 41", "08 44", "08 50", "08 51", "08 52", "08 53"), True, r"^(aluminum|vinyl|wood|steel|metal[\-\s]?clad|storefront|curtain\s*wall|glass)?\s*windows?(\s*:?\s*\d+\s+ea)?\s*$"),
    "finish": ("csi_section", ("09 ", "06 64", "03 35"), True, r"^(?:carpet|tile|paint|vct|vinyl|hardwood|wood\s+floor(?:ing)?|polished\s+concrete|sealed\s+concrete|resilient\s+base|acoustic\s+ceiling|wallcovering|wall\s+covering|frp|gypsum\s+board|gyp\s+(?:bd|board)|interior\s+wall\s+painting|other\s+flooring)\b[^\n]*$"),
    "panel": ("csi_section", ("26 24", "26 28"), True, None),
    "lighting": ("csi_section", ("26 51", "26 55"), True, None),
    "hvac": ("csi_section", ("23",), True, None),
    "plumbing": ("csi_section", ("22",), True, None),
    "kitchen": ("csi_section", ("11 40",), True, None),
    "lab": ("csi_section", ("12 35", "11 53"), True, None),
    "av": ("csi_section", ("27",), True, None),
    "security": ("csi_section", ("28",), True, None),
}


def retire_family(rows: DataFrame, made: DataFrame, family: str, row_id: str, owner: str, text: str = "description", mark: str = "mark", aggregates: str | None = None) -> DataFrame:
    """`rows` without those of a family that `made` rows of the same owner replace.

    Only where an owner has made rows of the family do its family rows fall: those that name a made mark as a whole
    token, and those whose text is an aggregate of the family (`aggregates`, a pattern without case; the fixed one of
    the family by default, where there is one). Rows of other families and owners stay; a family is told by the start
    of its section, or by an aggregate's text where FAMILIES says so.
    """
    column, prefixes, by_text, pattern = FAMILIES[family]
    pattern = aggregates or pattern
    section = F.coalesce(F.trim(column), F.lit(""))
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | section.startswith(p)
    legacy = F.coalesce(F.trim(text).rlike("(?i)" + pattern), F.lit(False)) if pattern else F.lit(False)
    of_family = inside | legacy if by_text else inside
    covered = rows.where(of_family)
    owners = made.select(owner).where(F.col(owner).isNotNull()).distinct()
    kept = retire_covered(covered.where(~legacy), made, row_id, owner, text, mark)
    gone = covered.where(legacy).join(owners, owner, "left_semi").select(row_id)
    named = covered.where(~legacy).select(row_id).join(kept.select(row_id), row_id, "left_anti")
    return rows.join(gone.unionByName(named), row_id, "left_anti")


def nearest(vectors: DataFrame, every: int = 50, top: int = 5) -> DataFrame:
    """The `top` nearest by cosine for every row whose id is divisible by `every`, against all rows but itself.

    vectors: id, vector. The query set is stated (a fiftieth), compared in blocks with all rows; only the best of
    each block leave it, so what is shuffled is `top` rows a query and block.
    """
    queries = vectors.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    pairs = vectors.crossJoin(small_side(queries)).where("id <> query_id").select("query_id", "id", to_places(cosine(F.col("q"), F.col("vector")), 6).alias("score"))
    return top_rows(pairs, ["query_id"], [F.desc("score"), F.asc("id")], top).select("query_id", "rank", "id", "score")


OPENING_SF = {"door": 21.0, "window": 12.0}


def openings_by_room(doors: DataFrame, rooms: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """bid_id, room, n_openings, opening_sf of rooms that exist: width x height / 144 each, where unknown 21 SF a door, 12 a window."""
    known = rooms.select("bid_id", "room").where("bid_id is not null and room is not null").distinct()
    columns = ["bid_id", "room", "width_in", "height_in"]
    every = doors.select(*columns, F.lit(OPENING_SF["door"]).alias("usual"))
    every = every.unionByName(windows.select(*columns, F.lit(OPENING_SF["window"]).alias("usual"))) if windows is not None else every
    size = F.coalesce(F.col("width_in") * F.col("height_in") / 144, "usual")
    return every.join(known, ["bid_id", "room"], "left_semi").groupBy("bid_id", "room").agg(F.count(F.lit(1)).alias("n_openings"), F.sum(size.cast("decimal(18,6)")).cast("double").alias("opening_sf"))


def backfill(finishes: DataFrame, rooms: DataFrame, openings: DataFrame) -> DataFrame:
    """Quantities of finish rows from the geometry of their room.

    finishes: finish_id, bid_id, room, surface (floor, base, ceiling, wall_ALL, wall_N...); rooms: bid_id, room,
    area_sf, perimeter_ft, height_ft; openings as by openings_by_room. Floors and ceilings take the area, bases the
    perimeter or 4 times the root of the area (confidence .65), walls perimeter x height x share less openings.
    """
    joined = finishes.join(rooms, ["bid_id", "room"], "left").join(openings, ["bid_id", "room"], "left")
    around = F.coalesce("perimeter_ft", 4 * F.sqrt("area_sf"))
    share = F.when(F.col("surface") == "wall_ALL", 1.0).otherwise(0.25)
    raw = around * F.col("height_ft") * share
    wall = F.when(raw.isNotNull(), F.greatest(F.lit(0.0), raw - F.least(F.coalesce("opening_sf", F.lit(0.0)) * share, raw)))
    quantity = F.when(F.col("surface").isin("floor", "ceiling"), F.col("area_sf")).when(F.col("surface") == "base", around).when(F.col("surface").startswith("wall"), wall)
    confidence = F.when(quantity.isNull(), F.lit(None).cast("double")).when(F.col("surface").isin("floor", "ceiling") | F.col("perimeter_ft").isNotNull(), 0.92).otherwise(0.65)
    unit = F.when(F.col("surface") == "base", "LF").otherwise("SF")
    reason = F.when(quantity.isNull(), F.when(F.col("surface").startswith("wall") & F.col("area_sf").isNotNull(), "no height").otherwise("no area"))
    return joined.select("finish_id", "surface", to_places(quantity, 2).alias("quantity"), unit.alias("unit"), confidence.alias("confidence"), reason.alias("reason"))


def fan_out(df: DataFrame, rows: list[Column], keep: list[str]) -> DataFrame:
    """One row for each non-null struct of `rows`, beside the `keep` columns."""
    return df.select(*keep, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("made")).select(*keep, "made.*")


def first_source(rows: DataFrame, order: list[str], base: str, target: str) -> DataFrame:
    """Change of an index between two periods from the first source, in the order given, that has any value.

    rows: source, period, value. Base and target are taken as of their periods, never later; one row: source, v0, v1,
    factor (6 places, null where either is missing).
    """
    rank = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(order)])
    ranked = rows.withColumn("rank", rank).where("rank is not null and value is not null")
    by_source = ranked.groupBy("source", "rank").agg(
        F.max(F.when(F.col("period") <= base, F.struct("period", "value")))["value"].alias("v0"), F.max(F.when(F.col("period") <= target, F.struct("period", "value")))["value"].alias("v1")
    )
    best = by_source.agg(F.min_by(F.struct("source", "v0", "v1"), "rank").alias("s")).where("s is not null").select("s.*")
    return best.withColumn("factor", to_places(F.col("v1") / F.nullif(F.col("v0"), F.lit(0.0)), 6))


def resolve_unique(wanted: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row each wanted text names: by the first of `keys` whose value it equals in one row only.

    wanted: wanted_id, text; rows: row_id and the keys. Result: wanted_id, row_id, status (found, ambiguous, missing).
    """
    candidates = None
    for i, k in enumerate(keys):
        counted = rows.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("text")).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n")).withColumn("rank", F.lit(i))
        candidates = counted if candidates is None else candidates.unionByName(counted)
    joined = wanted.join(candidates, "text", "left")
    picked = joined.groupBy("wanted_id").agg(F.min(F.when(F.col("n") == 1, F.struct("rank", "row_id")))["row_id"].alias("row_id"), F.max("n").alias("most"))
    status = F.when(F.col("row_id").isNotNull(), "found").when(F.col("most") > 1, "ambiguous").otherwise("missing")
    return picked.select("wanted_id", "row_id", status.alias("status"))


def sum_by_needles(lines: DataFrame, needles: DataFrame) -> DataFrame:
    """Sum of the lines each group's needles hit, a line once a group: group_id, total, n_lines (none: no row).

    lines: line_id, section, description, amount; needles: group_id, needle. A needle hits a line whose section it
    equals or whose normalised description holds its words in a row; the latter is found by the needle's longest word.
    """
    words = lines.select("line_id", norm_description(F.col("description")).alias("d")).withColumn("word", F.explode(F.array_distinct(F.split("d", " "))))
    asked = needles.select("group_id", "needle", norm_description(F.col("needle")).alias("n"))
    asked = asked.withColumn("word", F.array_max(F.transform(F.split("n", " "), lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"])
    in_text = words.join(asked.where("n <> ''"), "word").where("contains(concat(' ', d, ' '), concat(' ', n, ' '))").select("group_id", "line_id")
    by_section = lines.join(asked, F.col("section") == F.col("needle")).select("group_id", "line_id")
    hits = in_text.unionByName(by_section).distinct().join(lines.select("line_id", "amount"), "line_id")
    return hits.groupBy("group_id").agg(F.sum(F.col("amount").cast("decimal(18,6)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n_lines"))
