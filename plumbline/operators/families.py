"""Takeoff rows out of typed schedule records, family by family: types, sections and fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import to_places
from .classify import first_match
from .lookups import fan_out

Rules = Sequence[tuple[tuple[str, ...], str]]

#: Words of a record's texts and the section they tell, in the order in which they are tried; last the section
#: of records without any of them.
DOOR_SECTIONS: Rules = (
    (("HOLLOW METAL", "HM"), "08 11 13"),
    (("STOREFRONT", "ALUMINUM", "ALUM"), "08 11 16"),
    (("GLASS", "GLAZED"), "08 80 00"),
    (("SCWD", "WOOD", "WD", "SC"), "08 14 13"),
    ((), "08 10 00"),
)
WINDOW_SECTIONS: Rules = (
    (("METAL CLAD", "METAL-CLAD", "CLAD WOOD", "ALCLAD"), "08 52 19"),
    (("VINYL",), "08 53 13"),
    (("STEEL",), "08 51 23"),
    (("WOOD", "WD"), "08 52 13"),
    (("ALUMINUM", "ALUM"), "08 51 13"),
    ((), "08 50 00"),
)
FLOOR_SECTIONS: Rules = (
    (("POL CONC", "POL-CONC", "POLISHED", "SEAL CONC", "SEAL-CONC", "SEALED", "SC", "POL"), "03 35 43"),
    (("SHEET VINYL", "SHT VINYL", "SHEET"), "09 65 16"),
    (("VCT", "VINYL", "LVT", "LVP"), "09 65 19"),
    (("CPT", "CARPET"), "09 68 13"),
    (("TILE", "CT", "CER", "PORC"), "09 30 13"),
    (("HW", "WD", "WOOD"), "09 64 29"),
    ((), "09 60 00"),
)
BASE_SECTIONS: Rules = (
    (("RB", "RUBBER", "RES", "VB", "TB"), "09 65 13"),
    (("CB", "CER", "CT"), "09 30 13"),
    (("WB", "WOOD", "WD"), "09 64 33"),
    ((), "09 60 00"),
)
WALL_SECTIONS: Rules = (
    (("FRP",), "06 64 00"),
    (("WC", "VWC", "WALLCOVERING", "WALL COVERING"), "09 72 00"),
    (("TILE", "CT", "CER", "PORC"), "09 30 13"),
    (("PT", "PAINT", "EP"), "09 91 23"),
    ((), "09 70 00"),
)
CEILING_SECTIONS: Rules = (
    (("ACT", "ACOUSTIC", "ACP", "ACOU"), "09 51 13"),
    (("EXPOSED", "OPEN", "EXP"), "09 00 00"),
    (("WD CEIL", "WOOD"), "09 64 29"),
    (("GYP", "GWB", "GYP BD", "GB"), "09 29 00"),
    ((), "09 50 00"),
)
SURFACE_SECTIONS = {"floor": FLOOR_SECTIONS, "base": BASE_SECTIONS, "wall": WALL_SECTIONS, "ceiling": CEILING_SECTIONS}
#: Words that make a lighting fixture an exterior one.
EXTERIOR_WORDS = ("EXTERIOR", "OUTDOOR", "SITE LIGHT", "POLE", "LANDSCAPE", "WALL PACK")
#: Sections by type of item.
TYPE_SECTIONS = {
    "hvac": {"AHU": "23 73 13", "RTU": "23 74 13", "VAV": "23 36 00", "PUMP": "23 22 23", "BOILER": "23 52 00", "CHILLER": "23 64 23", "FAN": "23 34 00", "OTHER": "23 00 00"},
    "plumbing": {
        "WATER_CLOSET": "22 41 13", "LAVATORY": "22 41 16", "URINAL": "22 41 13", "SHOWER": "22 41 23", "EWC": "22 47 13", "MOP_SINK": "22 41 19", "SINK": "22 41 19",
        "WATER_HEATER": "22 33 00", "HOSE_BIBB": "22 11 23", "FLOOR_DRAIN": "22 13 19", "OTHER": "22 00 00",
    },
    "kitchen": {
        "RANGE": "11 40 13.13", "GRIDDLE": "11 40 13.13", "FRYER": "11 40 13.13", "OVEN": "11 40 13.13", "REFRIGERATOR": "11 40 16.13", "FREEZER": "11 40 16.13", "WALK_IN": "11 40 16.13",
        "ICE_MACHINE": "11 40 16.13", "DISHWASHER": "11 40 19.13", "MIXER": "11 40 13", "PREP_TABLE": "11 40 13", "SINK": "11 40 13", "HOOD": "11 40 13.16", "EXHAUST_FAN": "11 40 13.16", "OTHER": "11 40 00",
    },
    "lab": {
        "BASE_CABINET": "12 35 53.13", "WALL_CABINET": "12 35 53.13", "TALL_CABINET": "12 35 53.13", "LAB_BENCH": "12 35 53.13", "FUME_HOOD": "11 53 13", "SAFETY_CABINET": "11 53 43",
        "EYEWASH_STATION": "22 45 19", "OTHER": "12 35 53",
    },
    "av": {
        "DISPLAY": "27 41 16.51", "PROJECTOR": "27 41 16.31", "CAMERA": "27 41 16.49", "MICROPHONE": "27 41 33.13", "SPEAKER": "27 41 33.16", "RACK": "27 11 26", "CONTROL_PROCESSOR": "27 41 19.13",
        "NETWORK_SWITCH": "27 21 33", "OTHER": "27 41 16",
    },
    "security": {
        "CARD_READER": "28 13 23.13", "CAMERA": "28 23 23", "MOTION_SENSOR": "28 16 13.13", "DOOR_CONTACT": "28 16 16.13", "KEYPAD": "28 13 23.16", "REQUEST_TO_EXIT": "28 13 33.13",
        "MAGLOCK": "28 13 43.13", "OTHER": "28 13 00",
    },
}
#: First letters of tags by type, in the order in which they are tried.
TAG_TYPES: dict[str, Rules] = {
    "hvac": (
        (("AHU",), "AHU"), (("RTU",), "RTU"), (("VAV", "VAV-BOX", "VAVBOX"), "VAV"), (("PUMP",), "PUMP"), (("BLR", "BOILER"), "BOILER"), (("CHL", "CHR", "CHILLER", "CH"), "CHILLER"),
        (("SF", "EF", "RF", "FAN", "EXHAUST FAN", "SUPPLY FAN", "RETURN FAN"), "FAN"), (("P",), "PUMP"), (("B",), "BOILER"), (("F",), "FAN"),
    ),
    "plumbing": (
        (("WC",), "WATER_CLOSET"), (("LAV",), "LAVATORY"), (("URN", "UR"), "URINAL"), (("SHU",), "SHOWER"), (("SH",), "SHOWER"), (("EWC", "DF"), "EWC"), (("MS",), "MOP_SINK"), (("SK",), "SINK"),
        (("WH",), "WATER_HEATER"), (("HD", "HB"), "HOSE_BIBB"), (("FD",), "FLOOR_DRAIN"), (("ICE",), "OTHER"), (("FT",), "OTHER"),
    ),
    "kitchen": (
        (("RANGE", "RA"), "RANGE"), (("GRIDDLE", "GRD", "GR"), "GRIDDLE"), (("FRYER", "FRY", "FR"), "FRYER"), (("OVEN", "OV"), "OVEN"), (("REFRIGERATOR", "REF", "RF"), "REFRIGERATOR"),
        (("FREEZER", "FRZ", "FZ"), "FREEZER"), (("WALKIN", "WI", "WIC", "WIF"), "WALK_IN"), (("ICE", "IM"), "ICE_MACHINE"), (("DISHWASHER", "DSH", "DW"), "DISHWASHER"), (("MIXER", "MIX", "MX"), "MIXER"),
        (("PREP", "PT", "PR"), "PREP_TABLE"), (("HOOD", "HD", "EH"), "HOOD"), (("EXHAUST", "EF"), "EXHAUST_FAN"), (("SINK", "SK"), "SINK"),
    ),
    "lab": (
        (("BC", "BCAB"), "BASE_CABINET"), (("WC", "WCAB"), "WALL_CABINET"), (("TC", "TCAB"), "TALL_CABINET"), (("FH", "FUME"), "FUME_HOOD"), (("LB", "BENCH"), "LAB_BENCH"), (("SC", "SAFETY"), "SAFETY_CABINET"),
        (("EW", "EYEWASH"), "EYEWASH_STATION"),
    ),
    "av": (
        (("DISPLAY", "DISP", "DSP", "MON"), "DISPLAY"), (("PROJECTOR", "PROJ", "PJ"), "PROJECTOR"), (("CAMERA", "CAM"), "CAMERA"), (("MICROPHONE", "MIC"), "MICROPHONE"), (("SPEAKER", "SPK", "SP"), "SPEAKER"),
        (("RACK", "EQR"), "RACK"), (("CONTROL", "CTRL"), "CONTROL_PROCESSOR"), (("SWITCH", "SW"), "NETWORK_SWITCH"),
    ),
    "security": (
        (("READER", "RDR", "DR", "CR"), "CARD_READER"), (("CAMERA", "CAM"), "CAMERA"), (("MOTION", "MOT", "PIR", "MS"), "MOTION_SENSOR"), (("DOOR", "DC"), "DOOR_CONTACT"), (("KEYPAD", "KP"), "KEYPAD"),
        (("RTE", "REX"), "REQUEST_TO_EXIT"), (("MAGLOCK", "MAG", "ML"), "MAGLOCK"),
    ),
}
#: Words of descriptions by type, in the order in which they are tried.
DESCRIPTION_TYPES: dict[str, Rules] = {
    "plumbing": (
        (("WATER CLOSET", "TOILET"), "WATER_CLOSET"), (("LAVATORY",), "LAVATORY"), (("URINAL",), "URINAL"), (("SHOWER",), "SHOWER"), (("DRINKING FOUNTAIN", "WATER COOLER"), "EWC"),
        (("MOP SINK", "SERVICE SINK"), "MOP_SINK"), (("SINK",), "SINK"), (("WATER HEATER",), "WATER_HEATER"), (("HOSE BIBB", "HOSE HYDRANT"), "HOSE_BIBB"), (("FLOOR DRAIN",), "FLOOR_DRAIN"),
    ),
    "kitchen": (
        (("RANGE",), "RANGE"), (("GRIDDLE",), "GRIDDLE"), (("FRYER",), "FRYER"), (("OVEN",), "OVEN"), (("REFRIGERATOR", "REFRIGERATED"), "REFRIGERATOR"), (("FREEZER",), "FREEZER"), (("WALK-IN", "WALK IN"), "WALK_IN"),
        (("ICE MACHINE", "ICE MAKER"), "ICE_MACHINE"), (("DISHWASHER", "DISH MACHINE"), "DISHWASHER"), (("MIXER",), "MIXER"), (("PREP TABLE", "WORK TABLE"), "PREP_TABLE"), (("EXHAUST FAN",), "EXHAUST_FAN"),
        (("EXHAUST HOOD", "HOOD"), "HOOD"), (("SINK",), "SINK"),
    ),
    "lab": (
        (("FUME HOOD", "FUMEHOOD", "BIOSAFETY"), "FUME_HOOD"), (("BASE CABINET",), "BASE_CABINET"), (("WALL CABINET",), "WALL_CABINET"), (("TALL CABINET",), "TALL_CABINET"),
        (("LAB BENCH", "LABORATORY BENCH"), "LAB_BENCH"), (("SAFETY CABINET",), "SAFETY_CABINET"), (("EYEWASH", "EYE WASH"), "EYEWASH_STATION"),
    ),
    "av": (
        (("DISPLAY", "MONITOR", "LCD", "OLED"), "DISPLAY"), (("PROJECTOR",), "PROJECTOR"), (("CONFERENCE CAM", "WEBCAM", "LECTURE CAPTURE"), "CAMERA"), (("MICROPHONE", "CEILING MIC"), "MICROPHONE"),
        (("SPEAKER", "LOUDSPEAKER"), "SPEAKER"), (("AV RACK", "EQUIPMENT RACK"), "RACK"), (("CONTROL PROCESSOR", "DSP"), "CONTROL_PROCESSOR"), (("NETWORK SWITCH", "POE SWITCH"), "NETWORK_SWITCH"),
    ),
    "security": (
        (("CARD READER", "PROX READER", "PROXIMITY READER"), "CARD_READER"), (("PTZ CAMERA", "DOME CAMERA", "FIXED CAMERA", "SURVEILLANCE", "CCTV"), "CAMERA"), (("MOTION SENSOR", "MOTION DETECTOR", "PIR SENSOR"), "MOTION_SENSOR"),
        (("DOOR CONTACT", "DOOR POSITION"), "DOOR_CONTACT"), (("KEYPAD",), "KEYPAD"), (("REQUEST TO EXIT", "REQUEST-TO-EXIT"), "REQUEST_TO_EXIT"), (("MAGNETIC LOCK", "MAGLOCK", "ELECTROMAGNETIC LOCK"), "MAGLOCK"),
    ),
}
#: Words of a description that make a camera the other family's.
OTHER_CAMERAS = {
    "av": ("SURVEILLANCE", "CCTV", "PTZ", "DOME", "FIXED DOME", "SECURITY CAMERA", "IP CAMERA SECURITY"),
    "security": ("CONFERENCE", "LECTURE", "WEBCAM", "HUDDLE", "VIDEO CONFERENCING", "CAPTURE", "TELEPRESENCE"),
}
#: Types that get a row of a kind, and types that don't.
DISCONNECTS = ("AHU", "RTU", "PUMP", "CHILLER", "FAN")
WASTE_TYPES = ("WATER_CLOSET", "URINAL", "FLOOR_DRAIN")
LAMPS = ("FLUORESCENT", "HID", "INCAN")
NO_LAB_TRIM = ("FUME_HOOD", "EYEWASH_STATION")
AV_PROGRAMMED = ("CONTROL_PROCESSOR", "NETWORK_SWITCH")
SECURITY_CABLED = ("CARD_READER", "CAMERA", "MOTION_SENSOR", "KEYPAD", "REQUEST_TO_EXIT", "MAGLOCK")
SECURITY_PROGRAMMED = ("CARD_READER", "MAGLOCK")
#: Amperes above which a panel is a switchboard, feet of an unmeasured feeder and their confidence, inches above
#: which a storefront is a curtain wall.
SWITCHBOARD_AMPS, FEEDER_FEET, FEEDER_SURE, CURTAIN_INCHES = 400, 50.0, 0.55, 96.0
#: Confidence of a counted and of an uncounted item, of rough-in and of plumbing trim; share kept a step.
COUNTED, UNCOUNTED, ROUGH_IN, TRIM, KEPT = 0.9, 0.55, 0.45, 0.7, 0.95


def has_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def by_words(text: Column, rules: Rules) -> Column:
    """Section of the first rule with a word in the text (compared in upper case); the last rule's for none or null."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    return first_match([(has_any(upper, words), section) for words, section in rules if words], rules[-1][1])


def window_section(texts: Column, width: Column, height: Column) -> Column:
    """As by_words; storefronts wider or higher than CURTAIN_INCHES, and curtain walls of any size, are curtain walls."""
    upper = F.upper(F.coalesce(texts, F.lit("")))
    large = F.coalesce(F.greatest(width, height), F.lit(0.0)) > CURTAIN_INCHES
    return F.when(upper.contains("CURTAIN") | (upper.contains("STOREFRONT") & large), "08 44 13").when(upper.contains("STOREFRONT"), "08 41 13").otherwise(by_words(texts, WINDOW_SECTIONS))


def item_type(family: str, tag: Column, description: Column) -> Column:
    """Type of an item by its tag's first part, by the tag's first letters, then by words of its description, else OTHER.

    A description stands in for a blank tag. A camera whose description is of the other family's is OTHER.
    """
    told = F.nullif(F.upper(F.trim(tag)), F.lit(""))
    raw = F.coalesce(told, F.nullif(F.upper(F.trim(description)), F.lit("")))
    text = F.when(told.isNotNull(), F.upper(F.coalesce(description, F.lit("")))).otherwise("")
    head = F.split(raw, r"[-_/\s]", 2)[0]
    rules: list[tuple[Column, str]] = [(raw.isNull(), "OTHER")]
    if family in OTHER_CAMERAS:
        rules.append((head.isin("CAM", "CAMERA") & has_any(text, OTHER_CAMERAS[family]), "OTHER"))
    rules += [(head.isin(*words), kind) for words, kind in TAG_TYPES[family]]
    rules += [(raw.rlike(r"^(?:" + "|".join(words) + r")(?!\p{L})"), kind) for words, kind in TAG_TYPES[family]]
    if family in OTHER_CAMERAS:
        rules.append((has_any(text, OTHER_CAMERAS[family]), "OTHER"))
    hints = DESCRIPTION_TYPES.get(family) or [(tuple(w for w in words if len(w) > 1), kind) for words, kind in TAG_TYPES[family]]
    rules += [(has_any(text, words), kind) for words, kind in hints if words]
    return first_match(rules, "OTHER")


def type_section(family: str, kind: Column) -> Column:
    """Section of a type; that of OTHER for null and unknown types."""
    known = TYPE_SECTIONS[family]
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(kind)), F.lit(known["OTHER"]))


def inherited(confidence: Column, share: float = KEPT) -> Column:
    """Confidence of a derived row: the share of its source's (clamped to 0..1) at 4 places, not below ROUGH_IN."""
    return F.greatest(F.lit(ROUGH_IN), to_places(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * share, 4))


def _row(role: str, section: Column | str, quantity: Column | float, unit: str, confidence: Column | float) -> Column:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(F.lit(role).alias("role"), as_column(section).alias("section"), as_column(quantity).cast("double").alias("quantity"), F.lit(unit).alias("unit"), as_column(confidence).cast("double").alias("confidence"))


def _told(name: str) -> Column:
    return F.coalesce(F.trim(name) != "", F.lit(False))


def _counted() -> tuple[Column, Column]:
    known = F.coalesce(F.col("quantity") > 0, F.lit(False))
    return F.when(known, F.col("quantity")).otherwise(1).cast("double"), F.when(known, COUNTED).otherwise(UNCOUNTED)


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _rows_of(family: str) -> list[Column]:
    quantity, sure = _counted()
    kind = F.upper(F.coalesce("kind", F.lit("OTHER")))
    own = type_section(family, F.col("kind")) if family in TYPE_SECTIONS else F.lit(None)
    made = _told("manufacturer") & _told("model_number")
    steps = lambda share: KEPT * share
    if family == "hvac":
        powered = (F.coalesce(F.col("motor_hp") > 0, F.lit(False)) | _told("voltage")) & kind.isin(*DISCONNECTS)
        return [_row("equipment", own, quantity, "EA", sure), _row("rough_in", "23 05 00", 1.0, "LS", ROUGH_IN), F.when(powered, _row("disconnect", "26 28 16", 1.0, "EA", inherited(sure)))]
    if family == "plumbing":
        pipes = F.when(kind.isin(*WASTE_TYPES), "22 13 16").otherwise("22 11 16")
        return [_row("fixture", own, quantity, "EA", sure), _row("rough_in", pipes, 1.0, "LS", ROUGH_IN), F.when(made, _row("trim", own, 1.0, "LS", TRIM))]
    if family == "kitchen":
        duct = kind.isin("HOOD", "EXHAUST_FAN")
        piped = _flag("water") | _flag("drain") | _flag("gas")
        rough = F.when(duct, "23 31 13").when(piped, "22 11 16").when(_flag("electric"), "26 27 26")
        return [_row("equipment", own, quantity, "EA", sure), F.when(rough.isNotNull(), _row("rough_in", rough, 1.0, "LS", inherited(sure))), F.when(made, _row("trim", own, 1.0, "LS", inherited(sure, steps(0.7))))]
    if family == "lab":
        rough = F.when(_flag("water") | _flag("gas") | _flag("vacuum"), "22 11 16").when(_flag("electric"), "26 27 26")
        trim = made & ~kind.isin(*NO_LAB_TRIM)
        return [_row("casework", own, quantity, "EA", sure), F.when(rough.isNotNull(), _row("rough_in", rough, 1.0, "LS", inherited(sure))), F.when(trim, _row("trim", own, 1.0, "LS", inherited(sure, steps(0.7))))]
    if family == "av":
        programmed = kind.isin(*AV_PROGRAMMED) | made
        return [_row("device", own, quantity, "EA", sure), _row("cabling", "27 15 13.13", 1.0, "LS", inherited(sure, steps(0.95))), F.when(programmed, _row("programming", own, 1.0, "LS", inherited(sure, steps(0.7))))]
    if family == "security":
        programmed = kind.isin(*SECURITY_PROGRAMMED) | made
        cabled = F.when(kind.isin(*SECURITY_CABLED), _row("cabling", "28 05 13", 1.0, "LS", inherited(sure, steps(0.95))))
        return [_row("device", own, quantity, "EA", sure), cabled, F.when(programmed, _row("programming", own, 1.0, "LS", inherited(sure, steps(0.7))))]
    if family == "lighting":
        blob = F.upper(F.concat_ws(" ", "description", "notes"))
        place = F.when(F.upper("mounting") == "WALL", "26 51 19").when(has_any(blob, EXTERIOR_WORDS), "26 56 00").otherwise("26 51 13")
        return [_row("fixture", place, quantity, "EA", sure), F.when(F.upper("lamp_type").isin(*LAMPS), _row("lamp", "26 55 53", 1.0, "LS", inherited(sure)))]
    if family == "door":
        texts = F.concat_ws(" ", "door_type", "material", "frame")
        marked, typed = _told("mark"), _told("door_type")
        return [_row("door", by_words(texts, DOOR_SECTIONS), 1.0, "EA", F.when(marked & typed, 0.92).when(marked | typed, 0.8).otherwise(0.6))]
    if family == "window":
        texts = F.concat_ws(" ", "window_type", "frame", "material", "operation")
        marked, typed = _told("mark"), _told("window_type")
        return [_row("window", window_section(texts, F.col("width_in"), F.col("height_in")), 1.0, "EA", F.when(marked & typed, 0.92).when(marked | typed, 0.8).otherwise(0.6))]
    raise ValueError(f"no such family: {family}")


#: The column without which a record makes no rows (doors and windows always make one).
TAGS = {"hvac": "tag", "plumbing": "tag", "kitchen": "tag", "lab": "tag", "av": "tag", "security": "tag", "lighting": "tag"}


def takeoff_rows(records: DataFrame, family: str, key: str = "record_id") -> DataFrame:
    """Takeoff rows of a family's records: key, role, division, section, quantity, unit, confidence.

    Every family reads `quantity` and what its rules name (kind, manufacturer, model_number, flags such as water, ...).
    Records with a blank tag make no rows; a quantity that is null or not positive counts as 1 at a lower confidence.
    """
    rows = records.where(_told(TAGS[family])) if family in TAGS else records
    rows = rows if "quantity" in rows.columns else rows.withColumn("quantity", F.lit(1.0))
    made = fan_out(rows, _rows_of(family), [key])
    return made.select(key, "role", F.left("section", F.lit(2)).alias("division"), "section", "quantity", "unit", "confidence")


def panel_rows(panels: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows of panels (key, bus_amps, main_amps, confidence, circuits array<struct<breaker_amps>>): the enclosure, one row a
    breaker size, feeder wire and conduit."""
    rating = F.coalesce(F.nullif(F.col("bus_amps"), F.lit(0)), "main_amps", F.lit(0))
    enclosure = _row("enclosure", F.when(rating > SWITCHBOARD_AMPS, "26 24 13").otherwise("26 24 16"), 1.0, "EA", F.col("confidence"))
    feeders = [_row("feeder_wire", "26 05 19", FEEDER_FEET, "LF", FEEDER_SURE), _row("feeder_conduit", "26 05 33", FEEDER_FEET, "LF", FEEDER_SURE)]
    fixed = fan_out(panels, [enclosure, *feeders], [key]).withColumn("amps", F.lit(None).cast("int"))
    circuits = panels.select(key, "confidence", F.explode("circuits.breaker_amps").alias("amps")).where("amps is not null")
    groups = circuits.groupBy(key, "confidence", "amps").agg(F.count(F.lit(1)).cast("double").alias("n"))
    breakers = groups.select(key, F.lit("breakers").alias("role"), F.lit("26 28 16").alias("section"), F.col("n").alias("quantity"), F.lit("EA").alias("unit"), inherited(F.col("confidence")).alias("confidence"), "amps")
    return fixed.unionByName(breakers).select(key, "role", F.left("section", F.lit(2)).alias("division"), "section", "amps", "quantity", "unit", "confidence")


def finish_rows(surfaces: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows of finishes (key, surface, code, room_number, room_name): section by surface and code, quantity 0 SF until the
    geometry is known, confidence by whether a room and a code are told."""
    wall = F.col("surface").startswith("wall")
    section = F.coalesce(F.when(wall, by_words(F.col("code"), WALL_SECTIONS)), *[F.when(F.col("surface") == s, by_words(F.col("code"), SURFACE_SECTIONS[s])) for s in ("floor", "base", "ceiling")])
    room = _told("room_number") | _told("room_name")
    sure = F.when(room & _told("code"), 0.92).when(room | _told("code"), 0.8).otherwise(0.6)
    return surfaces.select(key, "surface", "code", F.left(section, F.lit(2)).alias("division"), section.alias("section"), F.lit(0.0).alias("quantity"), F.lit("SF").alias("unit"), sure.alias("confidence"))
