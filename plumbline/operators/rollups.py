"""Roll-ups of takeoff, price and alternates rows: merges of schedules, totals by type and tier, tallies, checks, orders."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import exact_sum, to_places
from ..functions.similarity import first_leaders
from ..functions.text import norm

#: Types of alternates, tiers of prices, in the order of reports.
ALTERNATE_TYPES = ("ADDITIVE", "DEDUCTIVE", "SUBSTITUTION", "VE")
TIERS = ("EXACT", "CATEGORY", "INTERPOLATED", "PARAMETRIC", "MISSING", "MANUAL")
#: Similarity from which unnumbered rooms of one project are the same.
SAME_ROOM = 92.0


def merge_schedules(parts: DataFrame, key: str, pages: str, confidence: str) -> DataFrame:
    """Schedules of one key as one: key, n_parts, pages (distinct, in order), confidence (the highest)."""
    return parts.groupBy(key).agg(F.count(F.lit(1)).alias("n_parts"), F.array_sort(F.collect_set(pages)).alias("pages"), F.max(confidence).alias("confidence"))


def consolidate(df: DataFrame, key: str, numbers: Sequence[str], notes: str, source: str) -> DataFrame:
    """One row a key: the largest of each number (null for none and for 0), distinct notes joined by ` | `, sources in order."""
    most = [F.nullif(F.max(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0)).alias(c) for c in numbers]
    return df.groupBy(key).agg(*most, F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(notes), F.lit("")))), " | ").alias("notes"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))


def merge_rooms(rooms: DataFrame, owner: str, number: str, name: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Rooms of an owner as one row each: owner, number, name, the first value of each field in order, n_rows.

    Numbered rooms are the same by number. Unnumbered ones join, in order, the first leader with a name alike to SAME_ROOM,
    so distinct names of one owner are compared in one task; names are few beside rows. Unnumbered rooms without a name stay
    by themselves.
    """
    firsts = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    numbered = rooms.where(F.trim(number) != "")
    one = numbered.groupBy(owner, number).agg(F.min_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name), *firsts, F.min(order).alias(order), F.count(F.lit(1)).alias("n_rows"))
    rest = rooms.where(F.col(number).isNull() | (F.trim(number) == ""))
    named = rest.where(norm(F.col(name)) != "").withColumn("__norm", norm(F.col(name)))
    names = named.groupBy(owner, "__norm").agg(F.min(order).alias("__at"))
    kinds = dict(names.dtypes)

    def lead(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__at", "__norm"])
        texts = list(part["__norm"])
        return pd.DataFrame({owner: part[owner], "__norm": part["__norm"], "__leader": [texts[i] for i in first_leaders(texts, SAME_ROOM)]})

    led = names.groupBy(owner).applyInPandas(lead, f"{owner} {kinds[owner]}, __norm string, __leader string")
    joined = named.join(led, [owner, "__norm"])
    two = joined.groupBy(owner, "__leader").agg(F.min_by(name, order).alias(name), *firsts, F.min(order).alias(order), F.count(F.lit(1)).alias("n_rows")).withColumn(number, F.lit(None).cast("string")).drop("__leader")
    three = rest.where(F.coalesce(norm(F.col(name)), F.lit("")) == "").withColumn("n_rows", F.lit(1).cast("bigint")).withColumn(number, F.lit(None).cast("string"))
    columns = [owner, number, name, *fields, order, "n_rows"]
    return one.select(*columns).unionByName(two.select(*columns)).unionByName(three.select(*columns))


def by_type_and_all(df: DataFrame, kind: str, amount: str, missing: Column) -> DataFrame:
    """type, n, total, n_missing of each of ALTERNATE_TYPES, zeros included, and of `all` of them: one aggregation, rolled up."""
    known = df.where(F.col(kind).isin(*ALTERNATE_TYPES))
    rolled = known.rollup(kind).agg(F.count(F.lit(1)).alias("n"), F.coalesce(exact_sum(F.col(amount)), F.lit(0.0)).alias("total"), F.sum(missing.cast("bigint")).alias("n_missing"))
    named = rolled.select(F.coalesce(kind, F.lit("all")).alias("type"), "n", "total", "n_missing")
    every = df.sparkSession.createDataFrame([(t,) for t in (*ALTERNATE_TYPES, "all")], "type string")
    joined = F.broadcast(every).join(named, "type", "left")
    return joined.select("type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(to_places(F.col("total"), 2), F.lit(0.0)).alias("total"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


def tally(alternates: DataFrame, kind: str, amount: str, chosen: Column, base: DataFrame) -> DataFrame:
    """row, total, delta: the base (one row, column `base`), base with all of a type where there are any, base with the chosen ones."""
    known = alternates.where(F.col(amount).isNotNull())
    per = [F.count(F.when(F.col(kind) == t, 1)).alias(f"n_{t}") for t in ("ADDITIVE", "DEDUCTIVE", "VE")] + [F.coalesce(exact_sum(F.when(F.col(kind) == t, F.col(amount))), F.lit(0.0)).alias(f"s_{t}") for t in ("ADDITIVE", "DEDUCTIVE", "VE")]
    sums = known.agg(*per, F.coalesce(exact_sum(F.when(chosen, F.col(amount))), F.lit(0.0)).alias("s_chosen"))
    one = base.select("base").crossJoin(sums)  # one row each
    row = lambda label, delta: F.struct(F.lit(label).alias("row"), to_places(F.col("base") + F.coalesce(delta, F.lit(0.0)), 2).alias("total"), to_places(delta, 2).alias("delta"))
    rows = [row("base", F.lit(None).cast("double"))] + [F.when(F.col(f"n_{t}") > 0, row(f"base + {t}", F.col(f"s_{t}"))) for t in ("ADDITIVE", "DEDUCTIVE", "VE")] + [row("base + chosen", F.col("s_chosen"))]
    return one.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*")


def by_tier(lines: DataFrame, tier: str, amount: str) -> DataFrame:
    """tier, n, total of every tier, zeros included."""
    found = lines.groupBy(F.col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col(amount)).alias("total"))
    every = lines.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return F.broadcast(every).join(found, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def violated(lines: DataFrame, division: str, amount: str, suppressed: str) -> DataFrame:
    """check, holds: division totals add up to the whole; suppressed lines carry no amount; no amount is negative."""
    totals = lines.groupBy(division).agg(exact_sum(F.col(amount)).alias("t"))
    parts = totals.agg(F.sum(F.col("t").cast("decimal(28,6)")).alias("parts"))
    whole = lines.agg(F.sum(F.col(amount).cast("decimal(18,6)")).alias("whole"), F.count(F.when(F.col(suppressed) & (F.col(amount) != 0), 1)).alias("bad"), F.count(F.when(F.col(amount) < 0, 1)).alias("negative"))
    one = whole.crossJoin(parts)  # one row each
    rows = F.array(
        F.struct(F.lit("divisions add up").alias("check"), F.coalesce(F.abs(F.col("whole") - F.col("parts")) < 0.01, F.lit(True)).alias("holds")),
        F.struct(F.lit("suppressed lines are free").alias("check"), (F.col("bad") == 0).alias("holds")), F.struct(F.lit("no negative amount").alias("check"), (F.col("negative") == 0).alias("holds")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def milestones(total: Column, shares: Column) -> Column:
    """Amounts of milestones (percent) of a total, each to the cent."""
    return F.transform(shares, lambda s: to_places(total * s / 100, 2))


def section_opens(df: DataFrame, keys: Sequence[str], section: str, order: Sequence[str]) -> DataFrame:
    """`df` with opens_section: does the section differ from that of the row before, in this order within the keys?"""
    before = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("opens_section", ~F.coalesce(F.lag(section).over(before).eqNullSafe(F.col(section)), F.lit(False)) | (F.row_number().over(before) == 1))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, and how many there are."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"), F.count(F.lit(1)).alias("n_rows")).select(key, "r.*", "n_rows")


def titled(rows: DataFrame, ref: str, packages: DataFrame, keys: Sequence[str], title: Sequence[str], order: str) -> DataFrame:
    """`rows` with title: that of the first package one of whose keys is the reference, `(general)` without a reference,
    `(unknown: ...)` for one that names nothing. Packages are brought to one row a key before the join."""
    named = F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in title])
    known = None
    for k in keys:
        part = packages.where(F.trim(k) != "").select(F.col(k).alias("__key"), named.alias("__title"), F.col(order).alias("__at"))
        known = part if known is None else known.unionByName(part)
    known = known.groupBy("__key").agg(F.min_by("__title", "__at").alias("__title"), F.lit(True).alias("__known"))
    clean = F.nullif(F.trim(ref), F.lit(""))
    joined = rows.withColumn("__key", clean).join(known, "__key", "left")
    title_ = F.when(F.col("__key").isNull(), "(general)").when(F.col("__known"), F.coalesce("__title", "__key")).otherwise(F.concat(F.lit("(unknown: "), F.col(ref), F.lit(")")))
    return joined.withColumn("title", title_).drop("__key", "__title", "__known")


def first_of(rows: DataFrame, tables: Sequence[tuple[Column, dict[str, str]]], otherwise: str) -> Column:
    """The value of the first table that has its key, else `otherwise`: small fixed tables, no join."""
    found = [F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) for key, table in tables]
    return F.coalesce(*found, F.lit(otherwise))


def queue(band: Column, suppressed: Column, priced: Column) -> Column:
    """Queues a line stands in: priced, suppressed, auto, review, hand (with the suppressed), headline (priced, auto or review)."""
    each = [
        F.when(priced & ~suppressed, "priced"), F.when(suppressed, "suppressed"), F.when(~suppressed & (band == "AUTO"), "auto"), F.when(~suppressed & (band == "REVIEW"), "review"),
        F.when(suppressed | (band == "HAND"), "hand"), F.when(priced & ~suppressed & band.isin("AUTO", "REVIEW"), "headline"),
    ]
    return F.filter(F.array(*each), lambda q: q.isNotNull())


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """`df` with place (from 1) in an order within the keys that leaves no ties."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def surface_rows(rooms: DataFrame, owner: str, area: str, height: str, floor: str) -> DataFrame:
    """Derived quantities of an owner's rooms: floor area by floor code, ceiling area, wall area and gross area.

    Rooms without a height take the owner's mean height, 9 where none is known; walls are 4 times the root of the area by it.
    """
    known = rooms.where(F.col(owner).isNotNull())
    heights = known.groupBy(owner).agg(F.coalesce(F.avg(F.nullif(F.col(height), F.lit(0.0)).cast("decimal(18,6)")).cast("double"), F.lit(9.0)).alias("__h"))
    joined = known.join(heights, owner)
    sf = F.coalesce(F.col(area), F.lit(0.0))
    wall = 4 * F.sqrt(sf) * F.coalesce(F.nullif(F.col(height), F.lit(0.0)), "__h")
    row = lambda item, q: F.struct(item.alias("item"), q.cast("decimal(18,6)").alias("q"))
    code = F.coalesce(F.nullif(F.upper(F.trim(floor)), F.lit("")), F.lit("UNSPECIFIED"))
    made = joined.select(owner, F.explode(F.array(row(F.concat(F.lit("floor "), code), sf), row(F.lit("ceiling"), sf), row(F.lit("walls"), wall), row(F.lit("gross area"), sf))).alias("r"))
    return made.groupBy(owner, "r.item").agg(F.sum("r.q").alias("q"), F.count(F.lit(1)).alias("n_rooms")).select(owner, "item", F.round("q", 2).cast("double").alias("quantity"), "n_rooms")
