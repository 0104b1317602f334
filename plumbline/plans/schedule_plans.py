"""Queries of the schedule families: takeoff rows by fan-out, types of items, header tables.

Doors come from door_records. The other families have no table of their own here: their records are the rows of
hvac_records, to which type, flags and the like are given by the record's number, alike in the query and in its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import families, schedules
from ..sources.tables import load
from .registry import Registry

_REGISTRY = Registry()
query, queries, oracle_sql = _REGISTRY.query, _REGISTRY.queries, _REGISTRY.oracle_sql

# types and sections, written out again apart from those of the operators
_TYPES = {
    "hvac": "AHU 23 73 13, RTU 23 74 13, VAV 23 36 00, PUMP 23 22 23, BOILER 23 52 00, CHILLER 23 64 23, FAN 23 34 00, OTHER 23 00 00",
    "plumbing": "WATER_CLOSET 22 41 13, LAVATORY 22 41 16, URINAL 22 41 13, SHOWER 22 41 23, EWC 22 47 13, MOP_SINK 22 41 19, SINK 22 41 19, WATER_HEATER 22 33 00, HOSE_BIBB 22 11 23, FLOOR_DRAIN 22 13 19, OTHER 22 00 00",
    "kitchen": (
        "RANGE 11 40 13.13, GRIDDLE 11 40 13.13, FRYER 11 40 13.13, OVEN 11 40 13.13, REFRIGERATOR 11 40 16.13, FREEZER 11 40 16.13, WALK_IN 11 40 16.13, ICE_MACHINE 11 40 16.13, DISHWASHER 11 40 19.13, MIXER 11 40 13, "
        "PREP_TABLE 11 40 13, SINK 11 40 13, HOOD 11 40 13.16, EXHAUST_FAN 11 40 13.16, OTHER 11 40 00"
    ),
    "lab": "BASE_CABINET 12 35 53.13, WALL_CABINET 12 35 53.13, TALL_CABINET 12 35 53.13, LAB_BENCH 12 35 53.13, FUME_HOOD 11 53 13, SAFETY_CABINET 11 53 43, EYEWASH_STATION 22 45 19, OTHER 12 35 53",
    "av": "DISPLAY 27 41 16.51, PROJECTOR 27 41 16.31, CAMERA 27 41 16.49, MICROPHONE 27 41 33.13, SPEAKER 27 41 33.16, RACK 27 11 26, CONTROL_PROCESSOR 27 41 19.13, NETWORK_SWITCH 27 21 33, OTHER 27 41 16",
    "security": "CARD_READER 28 13 23.13, CAMERA 28 23 23, MOTION_SENSOR 28 16 13.13, DOOR_CONTACT 28 16 16.13, KEYPAD 28 13 23.16, REQUEST_TO_EXIT 28 13 33.13, MAGLOCK 28 13 43.13, OTHER 28 13 00",
}


def _pairs(family: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ", 1)) for x in _TYPES[family].split(", ")]


def _types_sql(family: str) -> str:
    return ", ".join(f"({i}, '{k}', '{s}')" for i, (k, s) in enumerate(_pairs(family)))


def _records(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """Records of a family out of hvac_records."""
    rows = load(spark, folder, "hvac_records")
    kinds = F.array(*[F.lit(k) for k, _ in _pairs(family)], F.lit("UNHEARD_OF"), F.lit(None))
    flag = lambda n: F.pmod("record_id", F.lit(n)) == 0
    kind = F.upper("equipment_type") if family == "hvac" else F.get(kinds, F.pmod("record_id", F.size(kinds)).cast("int"))
    return rows.select(
        "record_id", F.col("equipment_tag").alias("tag"), kind.alias("kind"), "manufacturer", "model_number", "quantity", "motor_hp", "voltage", "description", "notes",
        flag(3).alias("water"), flag(5).alias("drain"), flag(7).alias("gas"), flag(11).alias("vacuum"), F.when(flag(2), True).alias("electric"),
        F.get(F.array(F.lit("Wall"), F.lit("RECESSED"), F.lit(None)), F.pmod("record_id", F.lit(3)).cast("int")).alias("mounting"),
        F.get(F.array(F.lit("LED"), F.lit("hid"), F.lit("FLUORESCENT"), F.lit(None)), F.pmod("record_id", F.lit(4)).cast("int")).alias("lamp_type"),
    )


_BASE = """
with m(i, kind, own) as (values {types}),
r as (select record_id, equipment_tag tag, {kind} kind, coalesce(trim(manufacturer), '') <> '' and coalesce(trim(model_number), '') <> '' made, case when quantity > 0 then quantity else 1 end::double q,
  case when quantity > 0 then 0.9::double else 0.55::double end c, coalesce(motor_hp > 0, false) or coalesce(trim(voltage), '') <> '' powered, upper(concat_ws(' ', description, notes)) blob,
  record_id % 3 = 0 water, record_id % 5 = 0 drain, record_id % 7 = 0 gas, record_id % 11 = 0 vacuum, record_id % 2 = 0 electric, record_id % 3 m3, record_id % 4 m4 from hvac_records),
a as (select r.*, coalesce(m.own, o.own) own from r left join m on m.kind = r.kind join (select own from m where kind = 'OTHER') o on true where coalesce(trim(tag), '') <> ''),
f as ({parts})
select record_id, role, left(section, 2) division, section, quantity, unit, round(greatest(0.45, c0)::decimal(18,6), 4)::double confidence from f where section is not null
"""


def _sql(family: str, *parts: tuple[str, str, str, str, str, str]) -> str:
    """parts: role, section, quantity, unit, confidence before the floor, condition."""
    kinds = ", ".join(f"'{k}'" for k, _ in _pairs(family)) if family in _TYPES else "'OTHER'"
    n = len(_pairs(family)) + 2 if family in _TYPES else 1
    kind = "upper(equipment_type)" if family == "hvac" else f"[{kinds}, 'UNHEARD_OF', null][(record_id % {n}) + 1]"
    union = " union all ".join(f"select record_id, '{role}' role, {section} section, {quantity}::double quantity, '{unit}' unit, ({sure})::decimal(18,8) c0 from a where {when}" for role, section, quantity, unit, sure, when in parts)
    return _BASE.format(types=_types_sql(family if family in _TYPES else "hvac"), kind=kind, parts=union)


_HAIRCUT = "round((c * 0.95)::decimal(18,6), 4)"


def _step(share: str) -> str:
    return f"round((c * 0.95 * {share})::decimal(18,6), 4)"


@query(_sql("hvac", ("equipment", "own", "q", "EA", "c", "true"), ("rough_in", "'23 05 00'", "1", "LS", "0.45", "true"), ("disconnect", "'26 28 16'", "1", "EA", _HAIRCUT, "powered and kind in ('AHU', 'RTU', 'PUMP', 'CHILLER', 'FAN')")))
def fanout_hvac(spark: SparkSession, folder: str) -> DataFrame:
    return families.takeoff_rows(_records(spark, folder, "hvac"), "hvac")


@query(_sql("plumbing", ("fixture", "own", "q", "EA", "c", "true"), ("rough_in", "case when kind in ('WATER_CLOSET', 'URINAL', 'FLOOR_DRAIN') then '22 13 16' else '22 11 16' end", "1", "LS", "0.45", "true"), ("trim", "own", "1", "LS", "0.7", "made")))
def fanout_plumbing(spark: SparkSession, folder: str) -> DataFrame:
    return families.takeoff_rows(_records(spark, folder, "plumbing"), "plumbing")


@query(
    _sql(
        "kitchen", ("equipment", "own", "q", "EA", "c", "true"),
        ("rough_in", "case when kind in ('HOOD', 'EXHAUST_FAN') then '23 31 13' when water or drain or gas then '22 11 16' when electric then '26 27 26' end", "1", "LS", _HAIRCUT, "true"), ("trim", "own", "1", "LS", _step("0.7"), "made"),
    )
)
def fanout_kitchen(spark: SparkSession, folder: str) -> DataFrame:
    return families.takeoff_rows(_records(spark, folder, "kitchen"), "kitchen")


@query(
    _sql(
        "lab", ("casework", "own", "q", "EA", "c", "true"), ("rough_in", "case when water or gas or vacuum then '22 11 16' when electric then '26 27 26' end", "1", "LS", _HAIRCUT, "true"),
        ("trim", "own", "1", "LS", _step("0.7"), "made and coalesce(kind, '') not in ('FUME_HOOD', 'EYEWASH_STATION')"),
    )
)
def fanout_lab(spark: SparkSession, folder: str) -> DataFrame:
    return families.takeoff_rows(_records(spark, folder, "lab"), "lab")


@query(_sql("av", ("device", "own", "q", "EA", "c", "true"), ("cabling", "'27 15 13.13'", "1", "LS", _step("0.95"), "true"), ("programming", "own", "1", "LS", _step("0.7"), "made or kind in ('CONTROL_PROCESSOR', 'NETWORK_SWITCH')")))
def fanout_av(spark: SparkSession, folder: str) -> DataFrame:
    return families.takeoff_rows(_records(spark, folder, "av"), "av")


@query(
    _sql(
        "security", ("device", "own", "q", "EA", "c", "true"), ("cabling", "'28 05 13'", "1", "LS", _step("0.95"), "kind in ('CARD_READER', 'CAMERA', 'MOTION_SENSOR', 'KEYPAD', 'REQUEST_TO_EXIT', 'MAGLOCK')"),
        ("programming", "own", "1", "LS", _step("0.7"), "made or kind in ('CARD_READER', 'MAGLOCK')"),
    )
)
def fanout_security(spark: SparkSession, folder: str) -> DataFrame:
    return families.takeoff_rows(_records(spark, folder, "security"), "security")


_OUTSIDE = "regexp_matches(blob, 'EXTERIOR|OUTDOOR|SITE LIGHT|POLE|LANDSCAPE|WALL PACK')"


@query(_sql("lighting", ("fixture", f"case when m3 = 0 then '26 51 19' when {_OUTSIDE} then '26 56 00' else '26 51 13' end", "q", "EA", "c", "true"), ("lamp", "'26 55 53'", "1", "LS", _HAIRCUT, "m4 in (1, 2)")))
def fanout_lighting(spark: SparkSession, folder: str) -> DataFrame:
    return families.takeoff_rows(_records(spark, folder, "hvac"), "lighting")


@query("""
with d as (select record_id, upper(concat_ws(' ', door_type, material, frame)) t, coalesce(trim(mark), '') <> '' m, coalesce(trim(door_type), '') <> '' k from door_records),
s as (select *, case when regexp_matches(t, 'HOLLOW METAL|HM') then '08 11 13' when regexp_matches(t, 'STOREFRONT|ALUMINUM|ALUM') then '08 11 16' when regexp_matches(t, 'GLASS|GLAZED') then '08 80 00'
  when regexp_matches(t, 'SCWD|WOOD|WD|SC') then '08 14 13' else '08 10 00' end section from d)
select record_id, 'door' role, '08' division, section, 1.0::double quantity, 'EA' unit, (case when m and k then 0.92 when m or k then 0.8 else 0.6 end)::double confidence from s
""")
def fanout_door(spark: SparkSession, folder: str) -> DataFrame:
    return families.takeoff_rows(load(spark, folder, "door_records"), "door")


_WINDOW_TEXTS = ("Storefront", "curtain wall", "CLAD WOOD", "vinyl", "Steel", "wood", "alum", None)


@query("""
with d as (select record_id, ['Storefront', 'curtain wall', 'CLAD WOOD', 'vinyl', 'Steel', 'wood', 'alum', null][(record_id % 8) + 1] k, frame, width_in w, height_in h, coalesce(trim(mark), '') <> '' m from door_records),
e as (select *, upper(concat_ws(' ', k, frame)) t, coalesce(greatest(w, h), 0) big from d),
s as (select *, case when contains(t, 'CURTAIN') or (contains(t, 'STOREFRONT') and big > 96) then '08 44 13' when contains(t, 'STOREFRONT') then '08 41 13' when regexp_matches(t, 'METAL CLAD|METAL-CLAD|CLAD WOOD|ALCLAD') then '08 52 19'
  when contains(t, 'VINYL') then '08 53 13' when contains(t, 'STEEL') then '08 51 23' when regexp_matches(t, 'WOOD|WD') then '08 52 13' when regexp_matches(t, 'ALUMINUM|ALUM') then '08 51 13' else '08 50 00' end section from e)
select record_id, 'window' role, '08' division, section, 1.0::double quantity, 'EA' unit, (case when m and k is not null then 0.92 when m or k is not null then 0.8 else 0.6 end)::double confidence from s
""")
def fanout_window(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.array(*map(F.lit, _WINDOW_TEXTS))
    rows = load(spark, folder, "door_records").select("record_id", "mark", F.get(kinds, F.pmod("record_id", F.lit(8)).cast("int")).alias("window_type"), "frame", "width_in", "height_in")
    return families.takeoff_rows(rows.withColumn("material", F.lit(None).cast("string")).withColumn("operation", F.lit(None).cast("string")), "window")


@query("""
with p as (select o_orderkey record_id, case when o_orderkey % 3 = 0 then null else (o_orderkey % 9) * 100 end bus, case when o_orderkey % 4 = 0 then null else 225 end main, ((o_orderkey % 40) + 55) / 100.0 c from orders),
k as (select l_orderkey record_id, case when l_linenumber % 5 = 0 then null else 10 * (l_linenumber % 4 + 1) end amps from lineitem),
f as (select record_id, 'enclosure' role, case when coalesce(nullif(bus, 0), main, 0) > 400 then '26 24 13' else '26 24 16' end section, null::int amps, 1.0 quantity, 'EA' unit, c from p
  union all select record_id, 'feeder_wire', '26 05 19', null, 50.0, 'LF', 0.55 from p union all select record_id, 'feeder_conduit', '26 05 33', null, 50.0, 'LF', 0.55 from p
  union all select record_id, 'breakers', '26 28 16', amps::int, count(*), 'EA', greatest(0.45, round((any_value(c) * 0.95)::decimal(18,6), 4)) from k join p using (record_id) where amps is not null group by 1, 4)
select record_id, role, '26' division, section, amps, quantity::double quantity, unit, confidence from (select *, c::double confidence from f)
""")
def fanout_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Panels are orders here, their circuits the order's lines."""
    key = F.col("o_orderkey")
    panels = load(spark, folder, "orders").select(
        key.alias("record_id"), F.when(key % 3 != 0, key % 9 * 100).cast("int").alias("bus_amps"), F.when(key % 4 != 0, 225).alias("main_amps"), ((key % 40 + 55) / 100).alias("confidence")
    )
    lines = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.struct(F.when(F.col("l_linenumber") % 5 != 0, 10 * (F.col("l_linenumber") % 4 + 1)).cast("int").alias("breaker_amps")).alias("c"))
    circuits = lines.groupBy("record_id").agg(F.collect_list("c").alias("circuits"))  # a few lines an order
    return families.panel_rows(panels.join(circuits, "record_id", "left"))


# tags and descriptions with the type they must give, by reading the rules of each family
_ITEMS = {
    "plumbing": [("WC-1", None, "WATER_CLOSET"), ("LAV-2A", None, "LAVATORY"), ("URN 3", None, "URINAL"), ("ur4", None, "URINAL"), ("SHU_1", None, "SHOWER"), ("DF-1", None, "EWC"), ("MS-1", None, "MOP_SINK"), ("SK7", None, "SINK"), ("HB/2", None, "HOSE_BIBB"),
        ("FD-9", "sink", "FLOOR_DRAIN"), ("ICE-1", "shower", "OTHER"), ("P-1", "Wall toilet", "WATER_CLOSET"), ("X-1", "service sink, floor", "MOP_SINK"), ("X-2", "kitchen sink", "SINK"), ("", "Water heater", "OTHER"), (None, "WH-3", "WATER_HEATER"), (None, None, "OTHER"), ("LAVX", None, "OTHER")],
    "kitchen": [("RANGE-1", None, "RANGE"), ("RA2", None, "RANGE"), ("FRY 1", None, "FRYER"), ("OV-1", "range", "OVEN"), ("WIC-1", None, "WALK_IN"), ("IM-2", None, "ICE_MACHINE"), ("DW_1", None, "DISHWASHER"), ("EH-1", None, "HOOD"), ("EF-1", None, "EXHAUST_FAN"), ("K-1", "Refrigerated case", "REFRIGERATOR"),
        ("K-2", "exhaust fan, roof", "EXHAUST_FAN"), ("K-3", "exhaust hood", "HOOD"), ("K-4", "ice maker", "ICE_MACHINE"), ("K-5", "work table", "PREP_TABLE"), ("K-6", "stool", "OTHER"), (" ", "oven", "OVEN"), (None, None, "OTHER")],
    "lab": [("BC-1", None, "BASE_CABINET"), ("WCAB-2", None, "WALL_CABINET"), ("FUME-1", None, "FUME_HOOD"), ("SC2", None, "SAFETY_CABINET"), ("EW-1", None, "EYEWASH_STATION"), ("L-1", "Biosafety hood", "FUME_HOOD"), ("L-2", "laboratory bench, steel", "LAB_BENCH"), ("L-3", "eye wash", "EYEWASH_STATION"), ("L-4", None, "OTHER")],
    "av": [("DISP-1", None, "DISPLAY"), ("MON2", None, "DISPLAY"), ("CAM-1", "Conference", "CAMERA"), ("CAM-2", "PTZ ceiling", "OTHER"), ("SPK-1", None, "SPEAKER"), ("SW-1", None, "NETWORK_SWITCH"), ("A-1", "LCD wall", "DISPLAY"), ("A-2", "dome unit with speaker", "OTHER"), ("A-3", "av rack", "RACK"), ("A-4", "poe switch", "NETWORK_SWITCH"),
        ("A-5", "dsp box", "CONTROL_PROCESSOR"), (None, "projector", "PROJECTOR")],
    "security": [("CR-1", None, "CARD_READER"), ("DR 4", None, "CARD_READER"), ("CAM-1", "dome", "CAMERA"), ("CAM-2", "lecture hall", "OTHER"), ("PIR-1", None, "MOTION_SENSOR"), ("DC1", None, "DOOR_CONTACT"), ("REX-1", None, "REQUEST_TO_EXIT"), ("ML-1", None, "MAGLOCK"), ("S-1", "cctv", "CAMERA"),
        ("S-2", "request-to-exit bar", "REQUEST_TO_EXIT"), ("S-3", "electromagnetic lock", "MAGLOCK"), ("S-4", "webcam", "OTHER"), ("S-5", "lamp", "OTHER")],
}


def _literal(v: object) -> str:
    return "null" if v is None else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)


_ITEM_ROWS = [(f, i, *row) for f, rows in _ITEMS.items() for i, row in enumerate(rows)]


@query("select * from (values " + ", ".join(f"('{f}', {i}, {_literal(k)})" for f, i, _, _, k in _ITEM_ROWS) + ") t(family, item_no, kind)")
def item_types(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([r[:4] for r in _ITEM_ROWS], "family string, item_no int, tag string, description string")
    kinds = F.coalesce(*[F.when(F.col("family") == f, families.item_type(f, F.col("tag"), F.col("description"))) for f in _ITEMS])
    return rows.select("family", "item_no", kinds.alias("kind"))


_HEADERS = [
    (1, ["Door No.", "Type", "Width", "Height", "Rating"], "door"), (2, ["WINDOW", "Size"], "window"), (3, ["Room Name", "Floor", "Base", "Wall"], "room"), (4, ["Finish", "Color", "Manufacturer"], "finish"),
    (5, ["Mark", "Qty"], "unknown"), (6, [], "unknown"), (7, ["DOOR"], "door"), (8, ["Mark", "Type", "Size", None], "door"), (9, ["window mark", "door type"], "door"),
]


@query("select * from (values " + ", ".join(f"({i}, '{k}')" for i, _, k in _HEADERS) + ") t(table_id, kind)")
def schedule_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(i, h) for i, h, _ in _HEADERS], "table_id int, headers array<string>")
    return rows.select("table_id", schedules.page_schedule_kind(F.col("headers")).alias("kind"))


_KIND_SETS = [(1, ["door", "window", "finish", "panel"], "door,panel"), (2, ["window", "room", "hvac"], "window,hvac"), (3, ["finish", "room"], "finish,room"), (4, ["panel", "av"], "panel,av"), (5, [], "")]


@query("select * from (values " + ", ".join(f"({i}, '{k}')" for i, _, k in _KIND_SETS) + ") t(page_id, kinds)")
def schedule_precedence(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(i, k) for i, k, _ in _KIND_SETS], "page_id int, kinds array<string>")
    return rows.select("page_id", F.array_join(schedules.dominant(F.col("kinds")), ",").alias("kinds"))


@query("""
with f as (select record_id, (width_in is not null)::int * 0.30 + (height_in is not null)::int * 0.20 + (material is not null)::int * 0.15 + (frame is not null)::int * 0.20 + (remarks is not null)::int * 0.15 s from door_records)
select record_id, least(1.0, round(s::decimal(18,6), 4))::double score, s >= 0.65 used from f
""")
def prepass_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "door_records")
    score = schedules.prepass_score([F.col(c).isNotNull() for c in ("width_in", "height_in", "material", "frame", "remarks")])
    return rows.select("record_id", score.alias("score")).withColumn("used", F.col("score") >= schedules.PREPASS_USED)


@query("""
select record_id, (case when coalesce(trim(mark), '') <> '' and coalesce(trim(door_type), '') <> '' then 0.92 when coalesce(trim(mark), '') <> '' or coalesce(trim(door_type), '') <> '' then 0.80 else 0.60 end)::double confidence from door_records
""")
def record_confidences(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "door_records").select("record_id", schedules.record_confidence(F.col("mark"), F.col("door_type")).alias("confidence"))


@query("""
select bid_id panel, 5 * (source_page % 6 + 3) amps, count(*) n from door_records where source_page is not null and bid_id is not null group by 1, 2
""")
def breaker_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Circuits by size; panels are bids here, circuits their door records, told apart by page."""
    rows = load(spark, folder, "door_records").where("bid_id is not null").select(F.col("bid_id").alias("panel"), F.array(F.struct((5 * (F.col("source_page") % 6 + 3)).alias("breaker_amps"))).alias("circuits"))
    return schedules.breaker_groups(rows)


_TABLES = [
    (1, ["MARK", "FRAME WIDTH", "WIDTH", "HEIGHT", "FIRE RATING"], [["101A", "x", "3'-0\"", "7'-0\"", "90 MIN"], ["-", "", "", "", ""], ["102", None, "36\"", "84", "--"]]),
    (2, ["Hardware", "Door No"], [["HW-1", "7"], ["HW-2", "8"]]), (3, ["MARK"], [["one row only"]]),
]
_TABLE_SCHEMA = "table_id int, headers array<string>, rows array<array<string>>"


@query("""
select * from (values (1, 0, '101A', 36.0::double, 84.0::double, '90 MIN', null), (1, 2, '102', 36.0::double, 84.0::double, null, null), (2, 0, '7', null, null, null, 'HW-1'), (2, 1, '8', null, null, null, 'HW-2'), (3, 0, 'one row only', null, null, null, null))
t(table_id, row_no, mark, width_in, height_in, fire_rating, hardware_set)
""")
def typed_doors(spark: SparkSession, folder: str) -> DataFrame:
    found = schedules.typed_records(spark.createDataFrame(_TABLES, _TABLE_SCHEMA), "door")
    return found.select("table_id", "row_no", "mark", "width_in", "height_in", "fire_rating", "hardware_set")


@query("""
select * from (values (1, 0, 'WIDTH', '3''-0"'), (1, 0, 'MARK', '101A'), (1, 1, 'MARK', '-'), (1, 1, 'WIDTH', ''), (1, 2, 'MARK', '102'), (1, 2, 'WIDTH', '36"'), (2, 0, 'Door No', '7'), (2, 1, 'Door No', '8'), (2, 0, 'Hardware', 'HW-1'), (2, 1, 'Hardware', 'HW-2'))
t(table_id, row_no, header, cell)
""")
def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    maps = schedules.row_maps(spark.createDataFrame(_TABLES, _TABLE_SCHEMA))
    return maps.select("table_id", "row_no", F.explode("cells").alias("header", "cell")).where(F.col("header").isin("WIDTH", "MARK", "Door No", "Hardware"))
