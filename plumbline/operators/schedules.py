"""Schedule tables: from header and cell arrays to typed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures
from ..functions.text import header_key
from .classify import best_header_match

#: Words of the headers of each kind of schedule, in the order in which ties are decided.
VOCABULARIES = {
    "door": ("DOOR", "MARK", "WIDTH", "HEIGHT", "THICKNESS", "FRAME", "HARDWARE", "FIRE", "RATING"),
    "window": ("WINDOW", "MARK", "GLAZING", "SILL", "HEAD", "OPERATION", "WIDTH", "HEIGHT"),
    "finish": ("FLOOR", "BASE", "WALL", "CEILING", "FINISH", "ROOM"),
    "room": ("ROOM", "NAME", "AREA", "PERIMETER", "CLG", "HT"),
    "panel": ("PANEL", "CIRCUIT", "BREAKER", "AMPS", "LOAD", "POLE"),
    "lighting": ("FIXTURE", "LAMP", "WATTS", "LUMENS", "VOLTAGE", "MOUNTING"),
    "hvac": ("EQUIPMENT", "TAG", "CFM", "CAPACITY", "HP", "MBH", "TONS", "VOLTAGE"),
    "plumbing": ("FIXTURE", "WASTE", "VENT", "CW", "HW", "TRAP", "GPF", "FLUSH"),
    "kitchen": ("ITEM", "EQUIPMENT", "BTU", "GAS", "WATER", "DRAIN", "EXHAUST"),
    "lab": ("CASEWORK", "FUME", "HOOD", "VACUUM", "GAS", "SINK"),
    "av": ("DISPLAY", "SPEAKER", "PROJECTOR", "RESOLUTION", "RACK"),
    "security": ("CAMERA", "READER", "LENS", "ACCESS", "CONTACT"),
}


def schedule_kind(headers: Column) -> Column:
    """Kind of a schedule by its headers; null where fewer than two words fit any kind."""
    return best_header_match(headers, VOCABULARIES)


#: Header words of a page's tables by kind, in the order in which ties are decided.
PAGE_WORDS = {
    "door": ("DOOR", "MARK", "TYPE", "SIZE", "FRAME", "HARDWARE", "WIDTH", "HEIGHT", "RATING"),
    "window": ("WINDOW", "MARK", "TYPE", "SIZE", "GLAZING", "WIDTH", "HEIGHT"),
    "room": ("ROOM", "NAME", "NUMBER", "FLOOR", "WALL", "CEILING", "BASE"),
    "finish": ("FINISH", "MATERIAL", "LOCATION", "COLOR", "MANUFACTURER"),
}
#: Score from which the typed schedules of a page are used.
PREPASS_USED = 0.65


def page_schedule_kind(headers: Column) -> Column:
    """Kind of a table on a page: most header words in common, 2 more for the words DOOR and WINDOW themselves; `unknown` below 2."""
    words = F.array_distinct(F.flatten(F.transform(headers, lambda h: F.regexp_extract_all(F.upper(F.coalesce(h, F.lit(""))), F.lit("[A-Z]+"), F.lit(0)))))
    scored = F.array(*[
        F.struct((F.size(F.array_intersect(words, F.array(*map(F.lit, known)))) + (F.array_contains(words, kind.upper()).cast("int") * 2 if kind in ("door", "window") else F.lit(0))).alias("score"), F.lit(-i).alias("rank"), F.lit(kind).alias("kind"))
        for i, (kind, known) in enumerate(PAGE_WORDS.items())
    ])
    best = F.array_max(scored)
    return F.when(best["score"] >= 2, best["kind"]).otherwise("unknown")


def dominant(kinds: Column) -> Column:
    """Kinds of one page after precedence: windows yield to doors, finishes and rooms to either."""
    doors, windows = F.array_contains(kinds, "door"), F.array_contains(kinds, "window")
    return F.filter(kinds, lambda k: ~((k == "window") & doors) & ~(k.isin("finish", "room") & (doors | windows)))


def column_at(headers: Column, words: Sequence[str], without: Sequence[str] = ()) -> Column:
    """Place (from 1) of the first header that has one of the words as a whole word, else as a part; null if none.

    Headers with any of the words in `without` are passed over.
    """
    keys = F.transform(headers, header_key)
    place = lambda test: F.nullif(F.array_position(F.transform(keys, lambda h: test(h) & ~_has(h, without)), F.lit(True)), F.lit(0))
    whole = [place(lambda h, w=w: F.array_contains(F.split(h, " "), w)) for w in words]
    part = [place(lambda h, w=w: h.contains(w)) for w in words]
    return F.coalesce(*whole, *part)


def _has(header: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | header.contains(w)
    return found


def cell(cells: Column, place: Column) -> Column:
    """Cleaned text of a cell, null where it is missing, blank or a dash."""
    text = F.trim(F.regexp_replace(F.try_element_at(cells, place.cast("int")), r"\s+", " "))
    return F.when(~text.isin("", "-", "--", "—", "N/A"), text)


def row_maps(tables: DataFrame) -> DataFrame:
    """Rows of tables (table_id, headers, rows array<array<string>>) as maps; tables of fewer than two rows fall out."""
    kept = tables.where(F.size("rows") >= 2)
    rows = kept.select("table_id", "headers", F.posexplode("rows").alias("row_no", "cells"))
    padded = F.transform(F.sequence(F.lit(1), F.size("headers")), lambda i: F.try_element_at("cells", i))
    unique = F.transform(F.sequence(F.lit(1), F.size("headers")), lambda i: F.concat(F.element_at("headers", i), F.when(F.array_position("headers", F.element_at("headers", i)) < i, F.concat(F.lit(" #"), i.cast("string"))).otherwise(F.lit(""))))
    return rows.select("table_id", "row_no", F.map_from_arrays(unique, padded).alias("cells"))


#: Fields of the records of each family. A field is (words of its header, words that rule a header out, kind);
#: kinds are text, inches, feet, area, int, volts, phases, or a unit pattern before which the number stands (bare numbers count).
FIELDS = {
    "door": {"mark": (("MARK", "DOOR", "NO"), (), "text"), "door_type": (("TYPE",), ("FRAME",), "text"), "width_in": (("WIDTH",), ("FRAME",), "inches"), "height_in": (("HEIGHT",), ("FRAME",), "inches"), "thickness_in": (("THICKNESS", "THK"), (), "inches"), "material": (("MATERIAL", "MATL"), ("FRAME",), "text"), "frame": (("FRAME",), (), "text"), "hardware_set": (("HARDWARE", "HDWR", "HW"), (), "text"), "fire_rating": (("RATING", "FIRE"), (), "text")},
    "window": {"mark": (("MARK", "WINDOW", "NO"), (), "text"), "width_in": (("WIDTH",), (), "inches"), "height_in": (("HEIGHT",), ("SILL", "HEAD"), "inches"), "sill_in": (("SILL",), (), "inches"), "glazing": (("GLAZING", "GLASS"), (), "text"), "operation": (("OPERATION", "TYPE"), (), "text")},
    "finish": {"room_number": (("ROOM", "NO"), ("NAME",), "text"), "room_name": (("NAME",), (), "text"), "floor_finish": (("FLOOR",), (), "text"), "base_finish": (("BASE",), (), "text"), "wall_finish": (("WALL", "WALLS"), (), "text"), "ceiling_finish": (("CEILING", "CLG"), ("HT", "HEIGHT"), "text"), "height_ft": (("HT", "HEIGHT"), (), "feet")},
    "room": {"room_number": (("ROOM", "NO"), ("NAME",), "text"), "room_name": (("NAME",), (), "text"), "area_sf": (("AREA",), (), "area"), "perimeter_ft": (("PERIMETER",), (), "lf|ft"), "height_ft": (("HT", "HEIGHT"), (), "feet")},
    "panel": {"circuit": (("CIRCUIT", "CKT", "NO"), (), "text"), "breaker_amps": (("BREAKER", "AMPS", "TRIP"), (), "a|amp|amps"), "load": (("LOAD", "DESCRIPTION"), ("WATTS", "VA"), "text"), "load_watts": (("WATTS", "VA"), (), "w|va|watts")},
    "lighting": {"tag": (("TYPE", "TAG", "MARK", "FIXTURE"), (), "text"), "description": (("DESCRIPTION",), (), "text"), "watts": (("WATTS", "WATTAGE"), (), "w|watts"), "lumens": (("LUMENS",), (), "lm|lumens"), "kelvin": (("KELVIN", "CCT"), (), "k"), "volts": (("VOLTAGE", "VOLTS"), (), "volts")},
    "hvac": {"tag": (("TAG", "MARK", "UNIT"), (), "text"), "description": (("DESCRIPTION", "SERVICE"), (), "text"), "cfm": (("CFM", "AIRFLOW"), (), "cfm"), "hp": (("HP",), (), "hp"), "volts": (("VOLTAGE", "ELECTRICAL"), (), "volts"), "phase_count": (("PHASE", "VOLTAGE"), (), "phases"), "weight_lbs": (("WEIGHT",), (), "lb|lbs")},
    "plumbing": {"tag": (("TAG", "MARK", "FIXTURE"), (), "text"), "description": (("DESCRIPTION",), (), "text"), "waste_in": (("WASTE",), (), "inches"), "vent_in": (("VENT",), (), "inches"), "cw_in": (("CW",), (), "inches"), "hw_in": (("HW",), (), "inches"), "gpf": (("GPF", "FLUSH"), (), "gpf")},
    "kitchen": {"tag": (("ITEM", "NO", "TAG"), (), "text"), "description": (("DESCRIPTION", "EQUIPMENT"), (), "text"), "quantity": (("QTY", "QUANTITY"), (), "int"), "volts": (("VOLTAGE", "VOLTS"), (), "volts"), "btu": (("BTU", "GAS"), (), "btu|btuh|mbh"), "kw": (("KW",), (), "kw")},
    "lab": {"tag": (("TAG", "MARK", "ITEM"), (), "text"), "description": (("DESCRIPTION", "CASEWORK"), (), "text"), "width_in": (("WIDTH",), (), "inches"), "depth_in": (("DEPTH",), (), "inches"), "height_in": (("HEIGHT",), (), "inches")},
    "av": {"tag": (("TAG", "MARK", "DEVICE"), (), "text"), "description": (("DESCRIPTION",), (), "text"), "quantity": (("QTY", "QUANTITY"), (), "int"), "resolution": (("RESOLUTION",), (), "text"), "watts": (("POWER", "WATTS"), (), "w|watts")},
    "security": {"tag": (("TAG", "MARK", "DEVICE"), (), "text"), "description": (("DESCRIPTION",), (), "text"), "quantity": (("QTY", "QUANTITY"), (), "int"), "resolution": (("RESOLUTION", "LENS"), (), "text"), "room": (("ROOM", "LOCATION"), (), "text")},
}


def _typed(text: Column, kind: str) -> Column:
    if kind == "text":
        return text
    if kind == "inches":
        return measures.feet_inches(F.when(text.rlike(r"^[0-9./ ]+$"), F.concat(text, F.lit('"'))).otherwise(text))
    if kind == "int":
        return F.regexp_extract(text, r"^\s*([0-9]+)", 1).try_cast("int")
    simple = {"feet": measures.ceiling_feet, "area": measures.area, "volts": measures.voltage, "phases": measures.phases}
    if kind in simple:
        return simple[kind](text)
    return measures.quantity_before(F.when(text.rlike(r"^[0-9.,]+$"), F.concat(text, F.lit(" " + kind.split("|")[0]))).otherwise(text), kind)


def typed_records(tables: DataFrame, family: str) -> DataFrame:
    """Records of a family's tables (table_id, headers, rows array<array<string>>): table_id, row_no and the family's fields.

    Columns are found by their headers, in any order and under any of their names; cells that can't be read are null.
    Rows without the family's first field (mark, tag, number) fall out.
    """
    rows = tables.select("table_id", "headers", F.posexplode("rows").alias("row_no", "c"))
    fields = [_typed(cell(F.col("c"), column_at(F.col("headers"), words, without)), kind).alias(name) for name, (words, without, kind) in FIELDS[family].items()]
    return rows.select("table_id", "row_no", *fields).where(F.col(next(iter(FIELDS[family]))).isNotNull())


def record_confidence(mark: Column, kind: Column) -> Column:
    """.92 with mark and type, .80 with one of them, .60 with neither."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(has(mark) & has(kind), 0.92).when(has(mark) | has(kind), 0.8).otherwise(0.6)


def prepass_score(flags: Sequence[Column], weights: Sequence[float] = (0.30, 0.20, 0.15, 0.20, 0.15)) -> Column:
    """Sum of the weights whose flag holds, at most 1."""
    return F.least(F.lit(1.0), F.round(sum((F.when(f, w).otherwise(0.0) for f, w in zip(flags, weights)), F.lit(0.0)), 4))


def breaker_groups(panels: DataFrame) -> DataFrame:
    """Circuits by panel and breaker size: panel, amps, n; circuits without a size are left out."""
    circuits = panels.select("panel", F.explode("circuits").alias("c")).where("c.breaker_amps is not null")
    return circuits.groupBy("panel", F.col("c.breaker_amps").alias("amps")).agg(F.count(F.lit(1)).alias("n"))
