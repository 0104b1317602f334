"""Queries of the core operators over the project's tables, with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures, text
from ..functions.rounding import to_places
from ..operators import classify, families, lookups, records, reports, search, units
from ..sources import files
from ..sources.tables import load
from ..streaming import latest as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


@query("""
select sha256(full_text) content_hash, count(*) copies, arg_min(bundle_id, struct_pack(a := length(pdf_path), b := pdf_path)) bundle_id
from bundles where full_text is not null group by 1
""")
def content_hash_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return records.distinct_content(load(spark, folder, "bundles").select("bundle_id", "pdf_path", "full_text"), "full_text", "pdf_path").select("content_hash", "copies", "bundle_id")


@query("""
select bundle_id, array_to_string(case when coalesce(page_count, 0) <= 0 then []::int[] else list_sort(list_distinct(list_filter(
  case when page_count <= 3 then range(0, page_count) when page_count <= 10 then range(0, 5) || range(page_count - 5, page_count) || range(page_count // 2 - 2, page_count // 2 + 3)
  else range(0, 5) || range(page_count - 5, page_count) || [page_count * 20 // 100, page_count * 35 // 100, page_count * 50 // 100, page_count * 65 // 100, page_count * 80 // 100] end,
  lambda p: p >= 0 and p < page_count))) end, ',') pages
from bundles
""")
def page_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "bundles").select("bundle_id", F.coalesce(F.array_join(records.page_sample(F.coalesce("page_count", F.lit(0))), ","), F.lit("")).alias("pages"))


# The lists below are written out again, apart from those of the operators, so that the check doesn't lean on them.
_PACKAGE = "BID PACKAGE|GENERAL INSTRUCTIONS TO BIDDERS|SPECIFIC INSTRUCTIONS TO BIDDERS|SPECIFIC INCLUSIONS|SPECIFIC EXCLUSIONS"
_SOLICITATION = (
    "REQUEST FOR PROPOSALS|REQUEST FOR PROPOSAL|REQUEST FOR QUOTATIONS|REQUEST FOR QUOTATION|REQUEST FOR QUOTE|REQUEST FOR COMPETITIVE SEALED PROPOSAL|RFCSP|SOLICITATION NUMBER|SOLICITATION NO.|SOLICITATION NO |OFFEROR|OFFERORS|"
    "CONTRACTING OFFICER|SECTION L|SECTION M|STATEMENT OF WORK|SCOPE OF WORK|SAM.GOV|BETA.SAM.GOV|ELECTRONIC STATE BUSINESS DAILY|ESBD|SF 1442|SF-1442|STANDARD FORM 1442|SF 33|SF-33|STANDARD FORM 33|PERIOD OF PERFORMANCE|"
    "MAGNITUDE OF CONSTRUCTION|PROJECT MAGNITUDE|NOTICE TO PROCEED"
)
_FORM = "BLANK BID FORM|BID FORM TEMPLATE|BID SCHEDULE|BID PROPOSAL FORM|PRICE SCHEDULE|PROPOSAL FORM|HUB SUBCONTRACTING PLAN|HSP GOOD FAITH EFFORT"
_MANUAL = (
    "GENERAL INSTRUCTIONS TO BIDDERS|QUESTIONNAIRE|PROJECT REQUIREMENTS|EXHIBIT|TABLE OF CONTENTS|INVITATION TO BID|WAGE DETERMINATION|DAVIS-BACON|DAVIS BACON|PREVAILING WAGE|GENERAL CONDITIONS|SUPPLEMENTARY GENERAL CONDITIONS|"
    "UNIFORM GENERAL CONDITIONS|SAMPLE CONSTRUCTION SERVICES AGREEMENT|TAX EXEMPTION|TAX EXEMPT|AMENDMENT TO SOLICITATION|AMENDMENT NUMBER|SOLICITATION AMENDMENT"
)


def _any(column: str, phrases: str) -> str:
    return f"len(list_filter(string_split('{phrases}', '|'), lambda p: contains({column}, p)))"


@query(rf"""
with b as (select bundle_id, pdf_name n, upper(coalesce(full_text, '')) u, coalesce(page_count, 0) pc, length(coalesce(full_text, '')) / greatest(coalesce(page_count, 0), 1) d from bundles)
select bundle_id, case when regexp_matches(n, '(?i)(^|[_\-\s.])drawings?([_\-\s.]|$)') then 'unknown'
  when regexp_matches(n, '(?i)wage[_\- ]determination|\bdol\b|davis[_\- ]bacon|prevailing[_\- ]wage|general[_\- ]conditions|_amd[_\- ]?[0-9]+|\bamendment\b|tax[_\- ]exemption|services[_\- ]agreement') then 'project_manual'
  when regexp_matches(n, '(?i)blank bid form|bid[_\- ]schedule|\bhsp\b|subcontracting[_\- ]plan|attachment[_\- ]a\b') then 'bid_form'
  when regexp_matches(n, '(?i)^[0-9]{{2}}[.\-][0-9]{{2}}[\s_\-]|^sol[_\-]|^esbd[_\-][0-9]+|\brfcsp\b|\brfp\b|^sow[_\-]|_solicitation_|notice[_\- ]of[_\- ]project') then 'bid_package'
  when {_any("u", _FORM)} >= 1 then 'bid_form' when {_any("u", _PACKAGE)} >= 2 or {_any("u", _SOLICITATION)} >= 2 then 'bid_package'
  when ({_any("u", _MANUAL)} >= 1 or regexp_matches(n, '(?i)(^|[_\-\s.])(project[_\-\s]*manual|project[_\-\s]*book|spec(ification)?s?)([_\-\s.]|$)')) and pc <= 500 and d > 600 then 'project_manual'
  when pc <= 3 and d > 400 then 'project_manual' else 'unknown' end kind
from b
""")
def document_classify(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "bundles").select("bundle_id", classify.document_kind(F.col("pdf_name"), F.col("full_text"), F.col("page_count")).alias("kind"))


@query("""
with s as (select unnest(source_sheet_ids) sheet from takeoff_template), p as (select regexp_extract(upper(sheet), '^([A-Z]{1,2})', 1) l from s),
m(k, v) as (values ('A', 'Architectural'), ('I', 'Interior'), ('S', 'Structural'), ('M', 'Mechanical'), ('E', 'Electrical'), ('P', 'Plumbing'), ('C', 'Civil'), ('L', 'Landscape'), ('F', 'Fire Protection'),
  ('FP', 'Fire Protection'), ('T', 'Telecom'), ('G', 'General'))
select coalesce(a.v, b.v) discipline, count(*) n_sheets from p left join m a on a.k = l left join m b on b.k = left(l, 1) group by 1
""")
def sheet_disciplines(spark: SparkSession, folder: str) -> DataFrame:
    sheets = load(spark, folder, "takeoff_template").select(F.explode("source_sheet_ids").alias("sheet"))
    return sheets.groupBy(measures.sheet_discipline(F.col("sheet")).alias("discipline")).agg(F.count(F.lit(1)).alias("n_sheets"))


@query("""
with f as (select *, (coalesce(door_type, '') <> '')::int + (coalesce(width_in, 0) <> 0)::int + (coalesce(material, '') <> '')::int + (coalesce(fire_rating, '') <> '')::int + (coalesce(remarks, '') <> '')::int n from door_records)
select bid_id, mark, record_id, door_type, width_in, material, fire_rating, remarks, first_seen from (
  select *, row_number() over (partition by bid_id, mark order by n desc, record_id) rn, min(record_id) over (partition by bid_id, mark) first_seen from f) where rn = 1
""")
def entity_most_complete(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["door_type", "width_in", "material", "fire_rating", "remarks"]
    return records.most_complete(load(spark, folder, "door_records").select("bid_id", "mark", "record_id", *fields), ["bid_id", "mark"], fields, "record_id")


@query("""
select bid_id, room_number, arg_min(room_name, record_id) filter (room_name is not null) room_name, arg_min(floor_finish, record_id) filter (floor_finish is not null) floor_finish,
  arg_min(area_sf, record_id) filter (area_sf is not null) area_sf, count(*) n_rows from finish_records group by 1, 2
""")
def room_merge(spark: SparkSession, folder: str) -> DataFrame:
    return records.first_filled(load(spark, folder, "finish_records"), ["bid_id", "room_number"], ["room_name", "floor_finish", "area_sf"], "record_id")


_MERGE_KEYS = "bid_id, coalesce(csi_section, csi_division) section, trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) item, upper(unit) unit"


@query(f"""
with t as (select {_MERGE_KEYS}, coalesce(quantity, 0)::decimal(18,6) q, coalesce(confidence, 0)::decimal(9,6) c, source_sheet_ids from takeoff_template where list_name = 'line_items'),
m as (select bid_id, section, item, unit, sum(q) q, sum((q * c)::decimal(28,9)) w, count(*) n_rows from t group by 1, 2, 3, 4),
l as (select bid_id, section, item, unit, array_to_string(list_sort(list_distinct(list(s))), ',') sources from (select bid_id, section, item, unit, unnest(source_sheet_ids) s from t) group by 1, 2, 3, 4)
select m.bid_id, m.section, m.item, m.unit, q::double quantity, round((w / nullif(q, 0))::decimal(18,6), 2)::double confidence, n_rows, coalesce(sources, '') sources
from m left join l on m.bid_id is not distinct from l.bid_id and m.section is not distinct from l.section and m.item is not distinct from l.item and m.unit is not distinct from l.unit
""")
def takeoff_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = records.merge_quantities(_takeoff_items(spark, folder), ["bid_id", "section", "item", "unit"], "quantity", "confidence", "source_sheet_ids")
    return merged.withColumn("sources", F.array_join("sources", ","))


def _takeoff_items(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "takeoff_template").where("list_name = 'line_items'")
    return lines.select("item_id", "bid_id", F.coalesce("csi_section", "csi_division").alias("section"), text.norm(F.col("description")).alias("item"), F.upper("unit").alias("unit"), "quantity", "confidence", "source_sheet_ids")


@query()
def takeoff_merge_fold(spark: SparkSession, folder: str) -> DataFrame:
    return records.fold_quantities(_takeoff_items(spark, folder), ["bid_id", "section", "item", "unit"], "quantity", "confidence", "item_id")


@query("""
with c as (select bid_id, source, count(*) votes from documents where trim(source) <> '' group by 1, 2)
select bid_id, source, votes from (select *, row_number() over (partition by bid_id order by votes desc, source desc) rn from c) where rn = 1
""")
def source_vote(spark: SparkSession, folder: str) -> DataFrame:
    return records.vote(load(spark, folder, "documents"), ["bid_id"], "source")


@query("""
select csi_division, count(distinct bid_id) n_bids, count(*) n_lines, min(bid_id) first_bid, count(distinct bid_id) > 1 shared
from takeoff_template where csi_division is not null group by 1
""")
def scope_matrix(spark: SparkSession, folder: str) -> DataFrame:
    by_bid = load(spark, folder, "takeoff_template").where("csi_division is not null").groupBy("csi_division", "bid_id").agg(F.count(F.lit(1)).alias("n"))
    matrix = by_bid.groupBy("csi_division").agg(F.count("bid_id").alias("n_bids"), F.sum("n").alias("n_lines"), F.min("bid_id").alias("first_bid"))
    return matrix.withColumn("shared", F.col("n_bids") > 1)


_ENTRIES = "select csi_section section, any_value(csi_division) division, min(line_id) entry_id, arg_min(trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')), line_id) words from price_sheet where csi_section is not null and description is not null group by 1"


@query(f"""
with e as ({_ENTRIES}), t as (select item_id, csi_section section, csi_division division, trim(regexp_replace(lower(regexp_replace(description, '^\\s*\\d{{2}}\\s\\d{{2}}\\s\\d{{2}}\\s*[-:.]?\\s*', '')), '[^a-z0-9]+', ' ', 'g')) d from takeoff_template where list_name = 'line_items'),
x as (select t.item_id, min(e.entry_id) exact from t left join e on t.section = e.section group by 1),
o as (select distinct t.item_id, t.division, unnest(string_split(t.d, ' ')) word from t join x on t.item_id = x.item_id and x.exact is null),
p as (select distinct entry_id, division, unnest(string_split(words, ' ')) word from e),
h as (select o.item_id, p.entry_id, count(*) hits, max(o.division is not distinct from p.division) same from o join p on o.word = p.word group by 1, 2),
b as (select item_id, arg_max(entry_id, struct_pack(a := hits, b := -entry_id)) filter (same) near, min(entry_id) anyhow from h group by 1)
select x.item_id, coalesce(exact, near, anyhow) entry_id, case when exact is not null then 'section' when near is not null then 'division' when anyhow is not null then 'any' end tier
from x left join b on x.item_id = b.item_id
""")
def lookup_three_tier(spark: SparkSession, folder: str) -> DataFrame:
    prices = load(spark, folder, "price_sheet").where("csi_section is not null and description is not null")
    entries = prices.groupBy(F.col("csi_section").alias("section")).agg(F.min("csi_division").alias("division"), F.min("line_id").alias("entry_id"), F.split(F.min_by(text.norm(F.col("description")), "line_id"), " ").alias("words"))
    items = load(spark, folder, "takeoff_template").where("list_name = 'line_items'").select("item_id", F.col("csi_section").alias("section"), F.col("csi_division").alias("division"), "description")
    return lookups.tiered_lookup(items, entries)


_MATERIAL = ", ".join(f"('{a}', '{u}', {f!r})" for fam, a, u, f in units.alias_rows() if fam == "material")


@query(f"""
with m(alias, unit, factor) as (values {_MATERIAL}), v as (select row_id, regexp_replace(regexp_replace(trim(lower(unit_of_measure)), '\\s+', ' ', 'g'), '[.\\s]+$', '') a from vendor_rows)
select v.row_id, m.unit, round(m.factor::decimal(18,6), 4)::double factor from v left join m on v.a = m.alias
""")
def uom_normalise(spark: SparkSession, folder: str) -> DataFrame:
    table = units.conversion_table(spark).where("family = 'material'").drop("family")
    rows = load(spark, folder, "vendor_rows").select("row_id", units.normal_unit(F.col("unit_of_measure")).alias("alias"))
    return rows.join(F.broadcast(table), "alias", "left").select("row_id", "unit", to_places(F.col("factor"), 4).alias("factor"))


@query(r"""
with m as (select distinct bid_id, lower(trim(mark)) mark from door_records where length(trim(mark)) >= 2), g as (select distinct bid_id from door_records),
t as (select item_id, bid_id, coalesce(description, '') d, coalesce(csi_division, '') v from takeoff_template where list_name = 'line_items'),
c as (select distinct t.item_id from t join m on t.bid_id = m.bid_id and v like '08%' and contains(lower(d), mark) and
  regexp_matches(' ' || lower(d) || ' ', '[^a-z0-9]' || regexp_escape(mark) || '[^a-z0-9]')),
l as (select t.item_id from t join g on t.bid_id = g.bid_id where v like '08%' and regexp_matches(trim(d), '(?i)^(hollow\s+metal|solid[\-\s]?core\s+wood|wood|steel|aluminum|glass)\s+doors?(\s*:?\s*[0-9]+\s+ea)?\s*$|^doors?\s*\(type\s+unspecified\)\s*$'))
select item_id from t where item_id not in (select item_id from c union all select item_id from l)
""")
def family_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "takeoff_template").where("list_name = 'line_items'")
    made = load(spark, folder, "door_records").select("bid_id", F.trim("mark").alias("mark"))
    return lookups.retire_family(lines, made, "door", "item_id", "bid_id").select("item_id")


def _surfaces(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "finish_records")
    made = lambda surface, code: F.when(F.trim(code) != "", F.struct(F.lit(surface).alias("surface"), code.alias("code")))
    fixed = [made("floor", F.col("floor_finish")), made("base", F.col("base_finish")), made("ceiling", F.col("ceiling_finish"))]
    walls = [made(f"wall_{side}", F.try_element_at("wall_finishes", F.lit(side))) for side in ("ALL", "N", "S", "E", "W")]
    return lookups.fan_out(rows, fixed + walls, ["record_id", "bid_id", "room_number"])


@query("""
with w as (select record_id, unnest(map_entries(wall_finishes)) e from finish_records),
a as (select record_id, 'floor' surface, floor_finish code from finish_records union all select record_id, 'base', base_finish from finish_records union all
  select record_id, 'ceiling', ceiling_finish from finish_records union all select record_id, 'wall_' || e.key, e.value from w where e.key in ('ALL', 'N', 'S', 'E', 'W'))
select surface, count(*) n_rows, count(distinct record_id) n_records, min(code) first_code from a where trim(code) <> '' group by 1
""")
def fanout_finish(spark: SparkSession, folder: str) -> DataFrame:
    return _surfaces(spark, folder).groupBy("surface").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record_id").alias("n_records"), F.min("code").alias("first_code"))


@query("""
with a as (select record_id, 'equipment' part, coalesce(quantity, 1)::double quantity, case when quantity > 0 then 0.9 else 0.55 end confidence from hvac_records where trim(equipment_tag) <> ''
union all select record_id, 'rough_in', 1.0, 0.45 from hvac_records where trim(equipment_tag) <> ''
union all select record_id, 'disconnect', 1.0, greatest(0.45, round((case when quantity > 0 then 0.9 else 0.55 end * 0.95)::decimal(18,6), 4)::double) from hvac_records
  where trim(equipment_tag) <> '' and (motor_hp is not null or voltage is not null) and equipment_type in ('AHU', 'RTU', 'PUMP', 'CHILLER', 'FAN'))
select part, confidence, count(*) n_rows, sum(quantity) quantity from a group by 1, 2
""")
def fanout_equipment(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "hvac_records").where(F.trim("equipment_tag") != "")
    sure = F.when(F.col("quantity") > 0, 0.9).otherwise(0.55)
    made = lambda part, q, c: F.struct(F.lit(part).alias("part"), q.alias("quantity"), c.alias("confidence"))
    switch = (F.col("motor_hp").isNotNull() | F.col("voltage").isNotNull()) & F.col("equipment_type").isin("AHU", "RTU", "PUMP", "CHILLER", "FAN")
    parts = [made("equipment", F.coalesce("quantity", F.lit(1)).cast("double"), sure), made("rough_in", F.lit(1.0), F.lit(0.45)), F.when(switch, made("disconnect", F.lit(1.0), classify.haircut(sure)))]
    made_rows = rows.select("record_id", sure.alias("sure"), "quantity", "motor_hp", "voltage", "equipment_type")
    return lookups.fan_out(made_rows, parts, ["record_id"]).groupBy("part", "confidence").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("quantity").alias("quantity"))


_ROOMS = "select bid_id, room_number room, arg_min(area_sf, record_id) filter (area_sf is not null) area_sf, arg_min(ceiling_height_ft, record_id) filter (ceiling_height_ft is not null) height_ft from finish_records where room_number is not null group by 1, 2"
_OPENINGS = f"select d.bid_id, d.room_number room, count(*) n_openings, sum(coalesce(d.width_in * d.height_in / 144, 21)::decimal(18,6))::double opening_sf from door_records d where exists (select 1 from ({_ROOMS}) r where r.bid_id = d.bid_id and r.room = d.room_number) group by 1, 2"


def _rooms(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "finish_records").where("room_number is not null").select("record_id", "bid_id", F.col("room_number").alias("room"), "area_sf", F.col("ceiling_height_ft").alias("height_ft"))
    return records.first_filled(rows, ["bid_id", "room"], ["area_sf", "height_ft"], "record_id").withColumn("perimeter_ft", F.lit(None).cast("double"))


def _openings(spark: SparkSession, folder: str) -> DataFrame:
    doors = load(spark, folder, "door_records").select("bid_id", F.col("room_number").alias("room"), "width_in", "height_in")
    return lookups.openings_by_room(doors, _rooms(spark, folder))


@query(_OPENINGS)
def openings_per_room(spark: SparkSession, folder: str) -> DataFrame:
    return _openings(spark, folder)


@query(f"""
with r as ({_ROOMS}), o as ({_OPENINGS}), w as (select record_id, bid_id, room_number room, unnest(map_entries(wall_finishes)) e from finish_records),
s as (select record_id, bid_id, room_number room, 'floor' surface from finish_records where trim(floor_finish) <> '' union all select record_id, bid_id, room_number, 'base' from finish_records where trim(base_finish) <> ''
  union all select record_id, bid_id, room_number, 'ceiling' from finish_records where trim(ceiling_finish) <> '' union all select record_id, bid_id, room, 'wall_' || e.key from w where trim(e.value) <> '' and e.key in ('ALL', 'N', 'S', 'E', 'W')),
j as (select s.record_id finish_id, s.surface, r.area_sf, r.height_ft, 4 * sqrt(r.area_sf) p, coalesce(o.opening_sf, 0) op, case when s.surface = 'wall_ALL' then 1.0::double else 0.25::double end sh
  from s left join r on s.bid_id = r.bid_id and s.room = r.room left join o on s.bid_id = o.bid_id and s.room = o.room),
q as (select *, case when surface in ('floor', 'ceiling') then area_sf when surface = 'base' then p when p * height_ft is not null then greatest(0, p * height_ft * sh - least(op * sh, p * height_ft * sh)) end v from j)
select finish_id, surface, round(v::decimal(18,6), 2)::double quantity, case when surface = 'base' then 'LF' else 'SF' end unit,
  case when v is null then null when surface in ('floor', 'ceiling') then 0.92::double else 0.65::double end confidence,
  case when v is null then case when surface like 'wall%' and area_sf is not null then 'no height' else 'no area' end end reason from q
""")
def backfill_geometry(spark: SparkSession, folder: str) -> DataFrame:
    finishes = _surfaces(spark, folder).select(F.col("record_id").alias("finish_id"), "bid_id", F.col("room_number").alias("room"), "surface")
    return lookups.backfill(finishes, _rooms(spark, folder), _openings(spark, folder))


@query(f"""
with r as ({_ROOMS}), h as (select bid_id, coalesce(avg(nullif(height_ft, 0)::decimal(18,6)), 9)::double h from r group by 1)
select r.bid_id, count(*) n_rooms, sum(coalesce(area_sf, 0)::decimal(18,6))::double gross_sf, round(any_value(h.h)::decimal(18,6), 3)::double height_ft,
  round(sum((4 * sqrt(coalesce(area_sf, 0)) * coalesce(nullif(height_ft, 0), h.h))::decimal(18,6)), 1)::double wall_sf
from r join h on r.bid_id = h.bid_id group by 1
""")
def derive_rooms(spark: SparkSession, folder: str) -> DataFrame:
    rooms = _rooms(spark, folder)
    heights = rooms.groupBy("bid_id").agg(F.coalesce(F.avg(F.nullif(F.col("height_ft"), F.lit(0.0)).cast("decimal(18,6)")).cast("double"), F.lit(9.0)).alias("h"))
    wall = (4 * F.sqrt(F.coalesce("area_sf", F.lit(0.0))) * F.coalesce(F.nullif(F.col("height_ft"), F.lit(0.0)), "h")).cast("decimal(18,6)")
    joined = rooms.join(heights, "bid_id").groupBy("bid_id").agg(
        F.count(F.lit(1)).alias("n_rooms"), F.sum(F.coalesce("area_sf", F.lit(0.0)).cast("decimal(18,6)")).cast("double").alias("gross_sf"), F.max("h").alias("h"), F.round(F.sum(wall), 1).cast("double").alias("wall_sf")
    )
    return joined.select("bid_id", "n_rooms", "gross_sf", to_places(F.col("h"), 3).alias("height_ft"), "wall_sf")


def _series(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").select(F.col("event_type").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("period"), "value", "ts", "event_id")
    return events.groupBy("series", "period").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


_SERIES = "select event_type series, strftime(ts, '%Y-%m-%d') period, arg_max(value, struct_pack(a := ts, b := event_id)) as value from events group by 1, 2"
_WANTED = [("2023-12-31", "2024-01-15"), ("2024-01-02", "2024-01-20"), ("2024-01-10", "2024-02-15")]
_DAYS = ", ".join(f"('{d}')" for pair in _WANTED for d in pair)


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    days = spark.createDataFrame(_WANTED, "base string, target string")
    return _series(spark, folder).select("series").distinct().crossJoin(F.broadcast(days))  # three rows


@query(f"""
with s as ({_SERIES}), d("at") as (values {_DAYS}), w as (select distinct s.series, d."at" from s, d),
a as (select w.series, w."at", max(s.period) filter (s.period <= w."at") pa, min(s.period) po from w join s on w.series = s.series group by 1, 2)
select a.series, a."at", s.period, s."value", pa is null late from a join s on s.series = a.series and s.period = coalesce(pa, po)
""")
def asof_value(spark: SparkSession, folder: str) -> DataFrame:
    wanted = _wanted(spark, folder)
    days = wanted.select("series", F.col("base").alias("at")).unionByName(wanted.select("series", F.col("target").alias("at")))
    return lookups.as_of(_series(spark, folder), days)


_PICK = "(select s.value from s where s.series = w.series and s.period = coalesce((select max(x.period) from s x where x.series = w.series and x.period <= {0}), (select min(x.period) from s x where x.series = w.series)))"


@query(f"""
with s as ({_SERIES}), d(base, target) as (values {", ".join(f"('{a}', '{b}')" for a, b in _WANTED)}), w as (select distinct s.series, d.base, d.target from s, d),
v as (select w.*, {_PICK.format("w.base")} v0, {_PICK.format("w.target")} v1 from w)
select series, base, target, coalesce(round((v1 / nullif(v0, 0))::decimal(18,6), 4)::double, 1.0) factor from v
""")
def change_factor(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.change_factor(_series(spark, folder), _wanted(spark, folder))


@query("""
select event_type series, arg_max(event_id, struct_pack(a := ts, b := strftime(ts, '%Y-%m-%d'), c := "value", d := event_id)) event_id from events group by 1
""")
def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "events").select(F.col("event_type").alias("series"), F.col("ts").alias("fetched_at"), F.date_format("ts", "yyyy-MM-dd").alias("period"), "value", "event_id")
    return files.latest(rows, ("series",)).select("series", "event_id")


@query("""
select event_type, date_trunc('day', ts) from_ts, count(*) n, sum("value"::decimal(18,6))::double total from events group by 1, 2
""")
def daily_events(spark: SparkSession, folder: str) -> DataFrame:
    return streams.windowed(load(spark, folder, "events"), "ts", "event_type", "value").withColumn("from_ts", F.col("from_ts").cast("timestamp_ntz"))


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings),
p as (select q.vec_id query_id, v.vec_id id, round((list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(v.e, lambda x: x * x)))))::decimal(18,6), 6)::double score
  from v q, v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id)
select query_id, rank::int rank, id, score from (select *, row_number() over (partition by query_id order by score desc, id) rank from p) where rank <= 5
""")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.nearest(load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


@query()
def tfidf_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "scope_items").where("trim(text) <> ''").select(F.col("scope_id").alias("id"), "text")
    terms = search.weighted_terms(rows)
    return search.search(terms, terms.where("id % 50 = 0"))


@query("select confidence_band, count(*) n_rows from (select case when suppressed then 'HAND' when confidence is null then 'REVIEW' when confidence >= 0.85 then 'AUTO' when confidence >= 0.65 then 'REVIEW' else 'HAND' end confidence_band from takeoff_template) group by 1")
def band_distribution(spark: SparkSession, folder: str) -> DataFrame:
    bands = load(spark, folder, "takeoff_template").select(classify.band(F.col("confidence"), F.coalesce("suppressed", F.lit(False))).alias("confidence_band"))
    return bands.groupBy("confidence_band").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""
with d as (select csi_division, quantity * unit_cost v from price_sheet), t as (select csi_division, count(*) n_rows, coalesce(sum(v::decimal(18,6))::double, 0) total from d group by 1)
select csi_division, n_rows, round(total::decimal(18,6), 2)::double total, coalesce(round((total / nullif((select sum(total::decimal(28,6))::double from t), 0))::decimal(18,6), 4)::double, 0) share from t
""")
def division_totals(spark: SparkSession, folder: str) -> DataFrame:
    return reports.totals_with_shares(load(spark, folder, "price_sheet"), "csi_division", F.col("quantity") * F.col("unit_cost"))


_CATEGORIES = ["material", "labor", "equipment", "subcontractor", "other"]


@query(f"""
select d.cost_category, count(p.line_id) n_rows, coalesce(sum(p.total_cost::decimal(18,6))::double, 0) total
from (values {", ".join(f"('{c}')" for c in _CATEGORIES)}) d(cost_category) left join price_sheet p on p.cost_category = d.cost_category group by 1
""")
def category_totals(spark: SparkSession, folder: str) -> DataFrame:
    found = load(spark, folder, "price_sheet").groupBy("cost_category").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("total_cost").cast("decimal(18,6)")).cast("double").alias("total"))
    return reports.with_all_of_domain(found, "cost_category", _CATEGORIES)


@query("""
with p as (select bundle_id, generate_subscripts(a, 1) - 1 page_no, unnest(a) body from (select bundle_id, regexp_split_to_array(full_text, '\\n?--- PAGE [0-9]+ ---\\n?') a from bundles where full_text is not null))
select bundle_id, count(*) n_pages, sum(length(body))::bigint n_chars from p where page_no >= 1 group by 1
""")
def bundle_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = reports.pages_of(load(spark, folder, "bundles"), "bundle_id", "full_text")
    return pages.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.char_length("body")).alias("n_chars"))


_T = "regexp_replace(regexp_replace(lower({0}), '[’′]', '''', 'g'), '[”″]|''''', '\"', 'g')"
_FEET_INCHES = """(case when f is not null or i is not null then coalesce(f * 12, 0) + coalesce(i, 0) end)"""


def _feet_sql(column: str, table: str, key: str) -> str:
    return f"""t as (select {key} k, {_T.format(column)} t from {table}), f as (select k, try_cast(nullif(regexp_extract(t, '^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(?:''|ft\\.?|feet|foot)', 1), '') as double) f,
      regexp_replace(t, '^\\s*[0-9]+(?:\\.[0-9]+)?\\s*(?:''|ft\\.?|feet|foot)\\s*-?\\s*', '') r, t from t),
    i as (select k, f, t, try_cast(nullif(regexp_extract(r, '^([0-9]+(?:\\.[0-9]+)?)(?:\\s+[0-9]+/[0-9]+)?\\s*(?:"|in\\b|in\\.|inch)', 1), '') as double)
      + coalesce(try_cast(nullif(regexp_extract(r, '^[0-9]+\\s+([0-9]+)/[0-9]+', 1), '') as double) / nullif(try_cast(nullif(regexp_extract(r, '^[0-9]+\\s+[0-9]+/([0-9]+)', 1), '') as double), 0), 0) i from f)"""


@query(f"with {_feet_sql('width_raw', 'door_records', 'record_id')} select k record_id, round({_FEET_INCHES}::decimal(18,6), 4)::double inches from i")
def dimension_parse(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "door_records").select("record_id", to_places(measures.feet_inches(F.col("width_raw")), 4).alias("inches"))


@query(f"with {_feet_sql('ceiling_height_raw', 'finish_records', 'record_id')} select k record_id, round(({_FEET_INCHES} / 12)::decimal(18,6), 4)::double feet from i")
def ceiling_parse(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "finish_records").select("record_id", to_places(measures.ceiling_feet(F.col("ceiling_height_raw")), 4).alias("feet"))


@query("""
select regexp_extract(upper(trim(floor_finish)), '^([A-Z]+)', 1) category, regexp_extract(upper(trim(floor_finish)), '([0-9]*)$', 1) variant, count(*) n_rows
from finish_records where regexp_matches(upper(trim(floor_finish)), '^[A-Z]{1,5}[- ]?[0-9]*$') group by 1, 2
""")
def finish_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes = load(spark, folder, "finish_records").select(measures.finish_code(F.col("floor_finish")).alias("c")).where("c is not null")
    return codes.groupBy("c.category", "c.variant").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""
select record_id, list_max(list_filter(list_transform(regexp_extract_all(voltage, '([0-9]{3})', 1), lambda v: try_cast(v as int)), lambda v: v between 100 and 600)) volts from hvac_records
""")
def voltage_parse(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "hvac_records").select("record_id", measures.voltage(F.col("voltage")).alias("volts"))


@query("""
select doc_id, case when not regexp_matches(text, '\\$\\s*_{2,}') then
  case when regexp_matches(text, '\\(\\s*\\$\\s*[0-9][0-9,]*(?:\\.[0-9]{1,2})?\\s*\\)') then -a else a end end delta
from (select doc_id, text, coalesce(try_cast(nullif(replace(regexp_extract(text, '\\$\\s*([0-9][0-9,]*(?:\\.[0-9]{1,2})?)', 1), ',', ''), '') as double),
  try_cast(nullif(replace(regexp_extract(text, '([0-9][0-9,]*(?:\\.[0-9]{1,2})?)\\s+(?:[Uu][Ss][Dd])\\b', 1), ',', ''), '') as double)) a from documents)
""")
def money_parse(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", measures.cost_delta(F.col("text")).alias("delta"))


@query("""
select item_id, try_cast(nullif(replace(regexp_extract(sq_ft, '^\\s*~?\\s*(?:approx\\.?\\s*)?\\[?([0-9][0-9,]*(?:\\.[0-9]+)?)\\]?\\s*(?:(?:sf|SF|Sf|sq\\.?\\s*ft\\.?|SQ\\.?\\s*FT\\.?|square feet)\\b.*)?$', 1), ',', ''), '') as double) area
from takeoff_template where list_name = 'rooms'
""")
def area_parse(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "takeoff_template").where("list_name = 'rooms'").select("item_id", measures.area(F.col("sq_ft")).alias("area"))


@query("""
with l as (select bid_id, mark, width_raw, extracted_at, record_id from door_records where width_raw is not null),
g as (select bid_id || ':' || mark door, list(width_raw order by extracted_at, record_id) h from l where bid_id is not null and mark is not null group by 1)
select door, h[-1] current, h[-2] before, array_to_string(h[-10:], '|') history, len(h)::int n_changes from g
""")
def override_history(spark: SparkSession, folder: str) -> DataFrame:
    log = load(spark, folder, "door_records").where("width_raw is not null and bid_id is not null and mark is not null")
    rows = log.select(F.concat_ws(":", "bid_id", "mark").alias("door"), F.struct("extracted_at", "record_id").alias("at"), "width_raw")
    return records.replay(rows, "door", "at", "width_raw").withColumn("history", F.array_join("history", "|"))


@query()
def scope_cluster(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "scope_items").where("trim(text) <> ''")
    keyed = rows.select("scope_id", F.concat_ws("|", "bid_id", "scope_kind").alias("block"), "text")
    return records.leader_clusters(keyed, "block", "text", "scope_id", 88.0)


@query(r"""
with a as (select item_id, notes, regexp_replace(regexp_replace(notes, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') t from takeoff_template),
b as (select item_id, notes, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') t from a)
select item_id, trim(regexp_replace(t, '\s+', ' ', 'g')) visible, nullif(trim(regexp_replace(regexp_extract(notes, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') title from b
""")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "takeoff_template").select("item_id", text.html_text(F.col("notes")).alias("visible"), text.html_title(F.col("notes")).alias("title"))


@query("""
with x as (select l_returnflag, l_linestatus, l_quantity::decimal(18,6) q, (l_extendedprice * (1 - l_discount))::decimal(18,6) p from lineitem)
select l_returnflag, l_linestatus, sum(q)::double quantity, sum(p)::double revenue, count(*) n_lines from x group by 1, 2
""")
def line_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "lineitem")
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,6)")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,6)")).cast("double").alias("quantity"), F.sum(revenue).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n_lines"))


@query("""
with x as (select n_name, o_orderpriority, count(*) votes from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)
select n_name, o_orderpriority, votes from (select *, row_number() over (partition by n_name order by votes desc, o_orderpriority desc) rn from x) where rn = 1
""")
def project_vote(spark: SparkSession, folder: str) -> DataFrame:
    nations = load(spark, folder, "nation")
    customers = load(spark, folder, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    voted = load(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return records.vote(voted, ["n_name"], "o_orderpriority")


_HEADS = "AHU AHU, RTU RTU, VAV VAV, PUMP PUMP, BLR BOILER, BOILER BOILER, CHL CHILLER, CHR CHILLER, CHILLER CHILLER, CH CHILLER, SF FAN, EF FAN, RF FAN, FAN FAN, P PUMP, B BOILER, F FAN"
_HEAD_ROWS = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(x.split() for x in _HEADS.split(", ")))


@query(f"""
with p(r, k, v) as (values {_HEAD_ROWS}),
h as (select record_id, equipment_type, upper(trim(coalesce(equipment_tag, ''))) t, upper(trim(coalesce(description, ''))) d from hvac_records),
n as (select record_id, equipment_type, case when t = '' then d else t end raw, case when t = '' then '' else d end d from h),
a as (select n.record_id, min(r) filter (regexp_split_to_array(raw, '[-_/\\s]')[1] = k) r1, min(r) filter (starts_with(raw, k) and not regexp_matches(substr(raw, length(k) + 1, 1), '[A-Z]')) r2,
  min(r) filter (length(k) > 1 and contains(d, k)) r3 from n, p group by 1)
select coalesce(x.v, y.v, z.v, 'OTHER') kind, equipment_type, count(*) n_rows from n join a using (record_id) left join p x on x.r = r1 left join p y on y.r = r2 left join p z on z.r = r3 group by 1, 2
""")
def equipment_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "hvac_records").select(families.item_type("hvac", F.col("equipment_tag"), F.col("description")).alias("kind"), "equipment_type")
    return rows.groupBy("kind", "equipment_type").agg(F.count(F.lit(1)).alias("n_rows"))


def _sections_sql(column: str, rules: str, otherwise: str) -> str:
    """A case of `WORD|WORD section; ...` over upper-case text."""
    whens = " ".join(f"when regexp_matches(upper({column}), '{words}') then '{section}'" for words, section in (r.rsplit(" > ", 1) for r in rules.split("; ")))
    return f"case {whens} else '{otherwise}' end"


_FLOORS = "POL CONC|POL-CONC|POLISHED|SEAL CONC|SEAL-CONC|SEALED|SC|POL > 03 35 43; SHEET VINYL|SHT VINYL|SHEET > 09 65 16; VCT|VINYL|LVT|LVP > 09 65 19; CPT|CARPET > 09 68 13; TILE|CT|CER|PORC > 09 30 13; HW|WD|WOOD > 09 64 29"
_BASES = "RB|RUBBER|RES|VB|TB > 09 65 13; CB|CER|CT > 09 30 13; WB|WOOD|WD > 09 64 33"
_WALLS = "FRP > 06 64 00; WC|VWC|WALLCOVERING|WALL COVERING > 09 72 00; TILE|CT|CER|PORC > 09 30 13; PT|PAINT|EP > 09 91 23"
_CEILINGS = "ACT|ACOUSTIC|ACP|ACOU > 09 51 13; EXPOSED|OPEN|EXP > 09 00 00; WD CEIL|WOOD > 09 64 29; GYP|GWB|GYP BD|GB > 09 29 00"


@query(f"""
with w as (select record_id, room_number, room_name, unnest(map_entries(wall_finishes)) e from finish_records),
a as (select record_id, room_number, room_name, 'floor' surface, floor_finish code from finish_records union all select record_id, room_number, room_name, 'base', base_finish from finish_records
  union all select record_id, room_number, room_name, 'ceiling', ceiling_finish from finish_records union all select record_id, room_number, room_name, 'wall_' || e.key, e.value from w where e.key in ('ALL', 'N', 'S', 'E', 'W'))
select record_id, surface, code, left(s, 2) division, s section, 0.0::double quantity, 'SF' unit,
  case when coalesce(trim(room_number), '') <> '' or coalesce(trim(room_name), '') <> '' then 0.92::double else 0.8::double end confidence
from (select *, case when surface = 'floor' then {_sections_sql("code", _FLOORS, "09 60 00")} when surface = 'base' then {_sections_sql("code", _BASES, "09 60 00")}
  when surface = 'ceiling' then {_sections_sql("code", _CEILINGS, "09 50 00")} else {_sections_sql("code", _WALLS, "09 70 00")} end s from a where trim(code) <> '')
""")
def finish_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "finish_records").select("record_id", "room_name")
    return families.finish_rows(_surfaces(spark, folder).join(rows, "record_id"))


@query("""
with s as (select event_type source, strftime(ts, '%Y-%m-%d') period, arg_max("value", struct_pack(a := ts, b := event_id)) v from events group by 1, 2),
o(source, r) as (values ('click', 0), ('purchase', 1), ('view', 2), ('signup', 3), ('error', 4)), f as (select source from s join o using (source) order by r limit 1),
x as (select s.source, arg_max(v, period) filter (period <= '2024-01-05') v0, arg_max(v, period) filter (period <= '2024-01-25') v1 from s join f on s.source = f.source group by 1)
select source, v0, v1, round((v1 / nullif(v0, 0))::decimal(18,6), 6)::double factor from x
""")
def macro_multiplier(spark: SparkSession, folder: str) -> DataFrame:
    rows = _series(spark, folder).withColumnRenamed("series", "source")
    return lookups.first_source(rows, ["click", "purchase", "view", "signup", "error"], "2024-01-05", "2024-01-25")


@query("""
with c as (select description t, min(line_id) row_id, count(*) n, 0 r from price_sheet where description is not null group by 1 union all select csp_form_line, min(line_id), count(*), 1 from price_sheet where csp_form_line is not null group by 1),
w as (select item_id wanted_id, regexp_replace(lower(description), '^.*: ', '') t from takeoff_template where list_name = 'line_items'),
j as (select wanted_id, arg_min(row_id, r) filter (n = 1) row_id, max(n) most from w left join c on w.t = c.t group by 1)
select row_id is not null found, case when row_id is not null then 'found' when most > 1 then 'ambiguous' else 'missing' end status, count(*) n_rows from j group by 1, 2
""")
def resolve_lines(spark: SparkSession, folder: str) -> DataFrame:
    wanted = load(spark, folder, "takeoff_template").where("list_name = 'line_items'").select(F.col("item_id").alias("wanted_id"), F.regexp_replace(F.lower("description"), "^.*: ", "").alias("text"))
    rows = load(spark, folder, "price_sheet").select(F.col("line_id").alias("row_id"), "description", "csp_form_line")
    found = lookups.resolve_unique(wanted, rows, ["description", "csp_form_line"])
    return found.groupBy(F.col("row_id").isNotNull().alias("found"), "status").agg(F.count(F.lit(1)).alias("n_rows"))


_NEEDLES = [(1, "duct"), (1, "23 15 19"), (2, "air barrier"), (3, "conduit"), (3, "cable tray"), (4, "no such thing")]


@query(f"""
with n(group_id, needle) as (values {", ".join(f"({g}, '{n}')" for g, n in _NEEDLES)}),
l as (select line_id, csi_section, trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) d, total_cost from price_sheet),
h as (select distinct group_id, line_id, total_cost from n join l on csi_section = needle or contains(' ' || d || ' ', ' ' || needle || ' '))
select group_id, sum(total_cost::decimal(18,6))::double total, count(*) n_lines from h group by 1
""")
def needle_sums(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "price_sheet").select("line_id", F.col("csi_section").alias("section"), "description", F.col("total_cost").alias("amount"))
    return lookups.sum_by_needles(lines, spark.createDataFrame(_NEEDLES, "group_id int, needle string"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
