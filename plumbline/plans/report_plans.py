"""Queries of roll-ups, report joins and orders, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, lookups, records, reports, rollups
from ..sources import files
from ..sources.tables import load
from .registry import Registry

_REGISTRY = Registry()
query, queries, oracle_sql = _REGISTRY.query, _REGISTRY.queries, _REGISTRY.oracle_sql


@query("""
select sheet_id, count(*) n_parts, array_to_string(list_sort(list_distinct(list(source_page))), ',') pages, max(confidence) confidence from door_records where sheet_id is not null group by 1
""")
def schedule_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = rollups.merge_schedules(load(spark, folder, "door_records").where("sheet_id is not null"), "sheet_id", "source_page", "confidence")
    return merged.withColumn("pages", F.array_join("pages", ","))


@query("""
select bid_id, nullif(max(coalesce(area_sf, 0)), 0) area_sf, nullif(max(coalesce(ceiling_height_ft, 0)), 0) ceiling_height_ft,
  coalesce(array_to_string(list_sort(list_distinct(list(nullif(trim(remarks, ' '), '')))), ' | '), '') notes, coalesce(array_to_string(list_sort(list_distinct(list(sheet_id))), ','), '') sources
from finish_records where bid_id is not null group by 1
""")
def site_consolidate(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.consolidate(load(spark, folder, "finish_records").where("bid_id is not null"), "bid_id", ["area_sf", "ceiling_height_ft"], "remarks", "sheet_id")


@query()
def room_merge_unnumbered(spark: SparkSession, folder: str) -> DataFrame:
    """Rooms of the takeoff, which have no numbers, merged by their names (SQL has no such ratio; tested against a plain fold)."""
    rooms = load(spark, folder, "takeoff_template").where("list_name = 'rooms'").withColumn("room_number", F.lit(None).cast("string"))
    return rollups.merge_rooms(rooms, "bid_id", "room_number", "room_name", "item_id", ["sq_ft", "use_type"])


_KINDS = "case o_orderkey % 5 when 0 then 'ADDITIVE' when 1 then 'DEDUCTIVE' when 2 then 'VE' when 3 then 'SUBSTITUTION' else 'ODD' end"
_DELTA = "case when o_orderkey % 7 = 0 then null when o_orderkey % 5 in (1, 2) then -o_totalprice else o_totalprice end"


def _alternates(spark: SparkSession, folder: str) -> DataFrame:
    """Alternates are orders here: type by number, every seventh without an amount."""
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ("ADDITIVE", "DEDUCTIVE", "VE", "SUBSTITUTION", "ODD"))), (k % 5).cast("int"))
    delta = F.when(k % 7 != 0, F.when((k % 5).isin(1, 2), -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
    return load(spark, folder, "orders").select(k.alias("alternate_no"), kind.alias("kind"), delta.alias("delta"), (k % 3 == 0).alias("chosen"), "o_orderstatus")


@query(f"""
with a as (select {_KINDS} kind, {_DELTA} delta from orders), k as (select * from a where kind <> 'ODD'), t(type) as (values ('ADDITIVE'), ('DEDUCTIVE'), ('SUBSTITUTION'), ('VE'))
select t.type, count(k.kind) n, round(coalesce(sum(delta::decimal(18,6)), 0), 2)::double total, (count(k.kind) - count(delta))::bigint n_missing from t left join k on k.kind = t.type group by 1
union all select 'all', count(*), round(coalesce(sum(delta::decimal(18,6)), 0), 2)::double, (count(*) - count(delta))::bigint from k
""")
def alternates_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.by_type_and_all(_alternates(spark, folder), "kind", "delta", F.col("delta").isNull())


@query(f"""
with a as (select {_KINDS} kind, {_DELTA} delta, o_orderkey % 3 = 0 chosen from orders), k as (select * from a where delta is not null), b as (select sum(total_cost::decimal(18,6))::double base from price_sheet),
s as (select kind, sum(delta::decimal(18,6))::double d from k where kind in ('ADDITIVE', 'DEDUCTIVE', 'VE') group by 1)
select 'base' as "row", round(base::decimal(18,6), 2)::double total, null::double delta from b union all select 'base + ' || kind, round((base + d)::decimal(18,6), 2)::double, round(d::decimal(18,6), 2)::double from s, b
union all select 'base + chosen', round((base + coalesce((select sum(delta::decimal(18,6))::double from k where chosen), 0))::decimal(18,6), 2)::double, round(coalesce((select sum(delta::decimal(18,6)) from k where chosen), 0), 2)::double from b
""")
def alternates_tally(spark: SparkSession, folder: str) -> DataFrame:
    base = load(spark, folder, "price_sheet").agg(F.sum(F.col("total_cost").cast("decimal(18,6)")).cast("double").alias("base"))
    return rollups.tally(_alternates(spark, folder), "kind", "delta", F.col("chosen"), base)


_TIER = "['EXACT', 'CATEGORY', 'PARAMETRIC', 'MISSING'][(line_id % 4) + 1]"


@query(f"""
with t(tier) as (values ('EXACT'), ('CATEGORY'), ('INTERPOLATED'), ('PARAMETRIC'), ('MISSING'), ('MANUAL')), p as (select {_TIER} tier, total_cost from price_sheet)
select t.tier, count(p.tier) n, coalesce(sum(total_cost::decimal(18,6)), 0)::double total from t left join p on p.tier = t.tier group by 1
""")
def tier_totals(spark: SparkSession, folder: str) -> DataFrame:
    tier = F.get(F.array(*map(F.lit, ("EXACT", "CATEGORY", "PARAMETRIC", "MISSING"))), (F.col("line_id") % 4).cast("int"))
    return rollups.by_tier(load(spark, folder, "price_sheet").withColumn("tier", tier), "tier", "total_cost")


@query("""
select unnest(['divisions add up', 'suppressed lines are free', 'no negative amount']) as "check", unnest([true, (select count(*) = 0 from price_sheet where line_id % 10 = 0 and total_cost <> 0), (select count(*) = 0 from price_sheet where total_cost < 0)]) holds
""")
def invariants(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "price_sheet").withColumn("suppressed", F.col("line_id") % 10 == 0)
    return rollups.violated(lines, "csi_division", "total_cost", "suppressed")


@query("""
select file_name, case when unit_of_measure is null then 'no unit' when quantity is null then 'no quantity' else 'complete' end bucket, count(*) n, coalesce(sum((unit_cost * quantity)::decimal(18,6)), 0)::double total from vendor_rows group by 1, 2
""")
def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    bucket = F.when(F.col("unit_of_measure").isNull(), "no unit").when(F.col("quantity").isNull(), "no quantity").otherwise("complete")
    rows = load(spark, folder, "vendor_rows").withColumn("bucket", bucket)
    return rows.groupBy("file_name", "bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("unit_cost") * F.col("quantity")).cast("decimal(18,6)")), F.lit(0)).cast("double").alias("total"))


@query("""
select o_orderkey, a amount, abs(s - o_totalprice) <= 1 fits from (select o_orderkey, o_totalprice, unnest([round((o_totalprice * 10 / 100)::decimal(18,6), 2)::double, round((o_totalprice * 40 / 100)::decimal(18,6), 2)::double, round((o_totalprice * 50 / 100)::decimal(18,6), 2)::double]) a,
  round((o_totalprice * 10 / 100)::decimal(18,6), 2)::double + round((o_totalprice * 40 / 100)::decimal(18,6), 2)::double + round((o_totalprice * 50 / 100)::decimal(18,6), 2)::double s from orders)
""")
def payment_schedule(spark: SparkSession, folder: str) -> DataFrame:
    amounts = rollups.milestones(F.col("o_totalprice"), F.array(*[F.lit(s) for s in (10.0, 40.0, 50.0)]))
    rows = load(spark, folder, "orders").select("o_orderkey", "o_totalprice", amounts.alias("amounts"))
    whole = F.aggregate("amounts", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("fits", F.abs(whole - F.col("o_totalprice")) <= 1).select("o_orderkey", F.explode("amounts").alias("amount"), "fits")


@query("""
select 'division' as facet, csi_division as value, count(*) n from takeoff_template group by 2 union all select 'list', list_name, count(*) from takeoff_template group by 2
union all select 'tag', regexp_extract(notes, '^\\[([a-z][a-z\\-]*)\\]\\s', 1), count(*) from takeoff_template where regexp_matches(notes, '^\\[[a-z][a-z\\-]*\\]\\s') group by 2
""".replace("\\\\", "\\"))
def calibration_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "takeoff_template")
    tag = F.nullif(F.regexp_extract("notes", r"^\[([a-z][a-z\-]*)\]\s", 1), F.lit(""))
    facets = [F.struct(F.lit("division").alias("facet"), F.col("csi_division").alias("value")), F.struct(F.lit("list").alias("facet"), F.col("list_name").alias("value")), F.when(tag.isNotNull(), F.struct(F.lit("tag").alias("facet"), tag.alias("value")))]
    counted = rows.select(F.explode(F.filter(F.array(*facets), lambda f: f.isNotNull())).alias("f"))
    return counted.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


@query("""
select event_type series, count(distinct strftime(ts, '%Y-%m-%d')) n_periods, min(strftime(ts, '%Y-%m-%d')) first_period, max(strftime(ts, '%Y-%m-%d')) last_period from events group by 1
""")
def series_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "events").select(F.col("event_type").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("period")).distinct()
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n_periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


@query("""
with b as (select bundle_id, pdf_name, regexp_extract(pdf_name, '^([0-9]+)', 1) no, sheet_type from bundles), p as (select pdf_name k, coalesce(nullif(trim(sheet_type), ''), pdf_name) t, bundle_id a from b union all select no, coalesce(nullif(trim(sheet_type), ''), pdf_name), bundle_id from b where no <> ''),
f as (select k, arg_min(t, a) t from p group by 1), s as (select scope_id, case when scope_id % 11 = 0 then null when scope_id % 13 = 0 then 'nowhere.pdf' else source_packages[1] end ref from scope_items)
select scope_id, case when nullif(trim(ref), '') is null then '(general)' when f.k is not null then f.t else '(unknown: ' || ref || ')' end title from s left join f on f.k = trim(ref)
""")
def package_titles(spark: SparkSession, folder: str) -> DataFrame:
    packages = load(spark, folder, "bundles").select("bundle_id", "pdf_name", F.regexp_extract("pdf_name", r"^([0-9]+)", 1).alias("number"), "sheet_type")
    ref = F.when(F.col("scope_id") % 11 == 0, None).when(F.col("scope_id") % 13 == 0, "nowhere.pdf").otherwise(F.get("source_packages", 0))
    rows = load(spark, folder, "scope_items").select("scope_id", ref.alias("ref"))
    return rollups.titled(rows, "ref", packages, ["pdf_name", "number"], ["sheet_type", "pdf_name"], "bundle_id").select("scope_id", "title")


_DIVISIONS = {"03": "Concrete", "08": "Openings", "09": "Finishes", "22": "Plumbing", "23": "HVAC", "26": "Electrical"}


@query("""
select line_id, case csi_division when '03' then 'Concrete' when '08' then 'Openings' when '09' then 'Finishes' when '22' then 'Plumbing' when '23' then 'HVAC' when '26' then 'Electrical' else '' end title from price_sheet
""")
def division_titles(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "price_sheet")
    return rows.select("line_id", rollups.first_of(rows, [(F.col("csi_division"), _DIVISIONS)], "").alias("title"))


@query("""
select sheet_id, arg_max(extractor, struct_pack(a := loaded_at, b := record_id)) extractor, arg_max(confidence, struct_pack(a := loaded_at, b := record_id)) confidence, count(*) n_rows from door_records where sheet_id is not null and loaded_at is not null group by 1
""")
def last_extraction(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "door_records").where("sheet_id is not null and loaded_at is not null").select("sheet_id", "extractor", "confidence", F.struct("loaded_at", "record_id").alias("at"))
    return rollups.last_per_key(rows, "sheet_id", "at").drop("at")


@query("""
with q as (select item_id, coalesce(suppressed, false) s, quantity is not null p, case when coalesce(suppressed, false) then 'HAND' when confidence is null then 'REVIEW' when confidence >= 0.85 then 'AUTO' when confidence >= 0.65 then 'REVIEW' else 'HAND' end b from takeoff_template)
select 'priced' queue, count(*) n from q where p and not s union all select 'suppressed', count(*) from q where s union all select 'auto', count(*) from q where not s and b = 'AUTO' union all select 'review', count(*) from q where not s and b = 'REVIEW'
union all select 'hand', count(*) from q where s or b = 'HAND' union all select 'headline', count(*) from q where p and not s and b in ('AUTO', 'REVIEW')
""")
def queue_views(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "takeoff_template")
    off = F.coalesce("suppressed", F.lit(False))
    queues = rollups.queue(classify.band(F.col("confidence"), off), off, F.col("quantity").isNotNull())
    return rows.select(F.explode(queues).alias("queue")).groupBy("queue").agg(F.count(F.lit(1)).alias("n"))


@query("""
with p as (select line_id, ((line_id % 50) + 50) / 100.0 q, ((line_id % 31) + 60) / 100.0 p, line_id % 17 = 0 s from price_sheet), c as (select *, round((coalesce(case when line_id % 7 = 0 then null else q end, 0.8) * p)::decimal(18,6), 4) c from p)
select line_id, case when s then 'HAND' when c >= 0.85 then 'AUTO' when c >= 0.65 then 'REVIEW' else 'HAND' end band from c
""")
def combined_bands(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("line_id")
    quantity = F.when(k % 7 != 0, (k % 50 + 50) / 100)
    return load(spark, folder, "price_sheet").select("line_id", classify.combined_band(quantity, (k % 31 + 60) / 100, k % 17 == 0).alias("band"))


@query("""
select item_id, greatest(0.45, round((confidence * [1.0, 0.95, 0.9, 0.85][least(item_id % 6, 3)::int + 1])::decimal(18,6), 4))::double confidence from takeoff_template where confidence is not null
""")
def chain_confidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "takeoff_template").where("confidence is not null")
    return rows.select("item_id", classify.chain_decay(F.col("confidence"), (F.col("item_id") % 6).cast("int")).alias("confidence"))


@query("""
with s as (select item_id, case when confidence is null then null else greatest(0, least(1, confidence)) end s from takeoff_template)
select item_id, (case when s >= 0.92 then s when s >= 0.75 then s * 0.85 when s >= 0.5 then 0.65 else 0.45 end)::double confidence from s where s is not null
""")
def price_confidences(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "takeoff_template").where("confidence is not null")
    return rows.select("item_id", classify.price_confidence(F.col("confidence")).alias("confidence"))


_LINE_ORDER = "csi_division nulls first, suppressed, total_cost desc nulls last, line_id"


@query(f"""
with p as (select *, line_id % 9 = 0 suppressed from price_sheet), r as (select bid_id, line_id, csi_division, row_number() over (partition by bid_id order by {_LINE_ORDER}) place, lag(csi_division) over (partition by bid_id order by {_LINE_ORDER}) before from p)
select bid_id, line_id, place, place = 1 or before is distinct from csi_division opens_section from r
""")
def line_order(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a bid in the order of reports, and where a division's heading goes."""
    rows = load(spark, folder, "price_sheet").withColumn("suppressed", F.col("line_id") % 9 == 0)
    placed = rollups.ranked(rows, ["bid_id"], [F.asc_nulls_first("csi_division"), F.asc("suppressed"), F.desc_nulls_last("total_cost"), F.asc("line_id")])
    return rollups.section_opens(placed, ["bid_id"], "csi_division", ["place"]).select("bid_id", "line_id", "place", "opens_section")


@query(f"""
with a as (select o_orderkey, {_KINDS} kind from orders) select o_orderkey alternate_no, row_number() over (partition by kind order by o_orderkey) place, case kind when 'ADDITIVE' then 0 when 'DEDUCTIVE' then 1 when 'SUBSTITUTION' then 2 when 'VE' then 3 else 4 end type_rank from a
""")
def alternate_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = _alternates(spark, folder)
    rank = F.coalesce(*[F.when(F.col("kind") == t, i) for i, t in enumerate(rollups.ALTERNATE_TYPES)], F.lit(len(rollups.ALTERNATE_TYPES)))
    return rollups.ranked(rows.withColumn("type_rank", rank), ["kind"], [F.asc("alternate_no")]).select("alternate_no", "place", "type_rank")


@query(f"""
select line_id, bid_id, row_number() over (partition by bid_id order by list_position(['EXACT', 'CATEGORY', 'INTERPOLATED', 'PARAMETRIC', 'MISSING', 'MANUAL'], {_TIER}), line_id) place from price_sheet
""")
def tier_order(spark: SparkSession, folder: str) -> DataFrame:
    tier = F.get(F.array(*map(F.lit, ("EXACT", "CATEGORY", "PARAMETRIC", "MISSING"))), (F.col("line_id") % 4).cast("int"))
    rank = F.array_position(F.array(*map(F.lit, rollups.TIERS)), tier)
    return rollups.ranked(load(spark, folder, "price_sheet"), ["bid_id"], [rank, F.asc("line_id")]).select("line_id", "bid_id", "place")


@query("""
select bid_id, bundle_id, row_number() over (partition by bid_id order by coalesce(nullif(regexp_extract(pdf_name, '^([0-9]{2}[.-][0-9]{2})', 1), ''), pdf_name), bundle_id) place from bundles
""")
def package_order(spark: SparkSession, folder: str) -> DataFrame:
    number = F.nullif(F.regexp_extract("pdf_name", r"^([0-9]{2}[.-][0-9]{2})", 1), F.lit(""))
    return rollups.ranked(load(spark, folder, "bundles"), ["bid_id"], [F.coalesce(number, "pdf_name"), F.asc("bundle_id")]).select("bid_id", "bundle_id", "place")


@query("select bundle_id, pdf_name from bundles order by pdf_name limit 5")
def first_files(spark: SparkSession, folder: str) -> DataFrame:
    """The first five files by name, as a run with a limit takes them (pdf_name is unique)."""
    return load(spark, folder, "bundles").orderBy("pdf_name").limit(5).select("bundle_id", "pdf_name")


@query("""
with f as (select * from finish_records where bid_id is not null), h as (select bid_id, coalesce(avg(nullif(ceiling_height_ft, 0)::decimal(18,6))::double, 9) h from f group by 1),
r as (select f.bid_id, coalesce(area_sf, 0) a, 4 * sqrt(coalesce(area_sf, 0)) * coalesce(nullif(ceiling_height_ft, 0), h) w, 'floor ' || coalesce(nullif(upper(trim(floor_finish, ' ')), ''), 'UNSPECIFIED') code from f join h on h.bid_id = f.bid_id),
x as (select bid_id, code item, a::decimal(18,6) q from r union all select bid_id, 'ceiling', a::decimal(18,6) from r union all select bid_id, 'walls', w::decimal(18,6) from r union all select bid_id, 'gross area', a::decimal(18,6) from r)
select bid_id, item, round(sum(q), 2)::double quantity, count(*) n_rooms from x group by 1, 2
""")
def derived_takeoffs(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.surface_rows(load(spark, folder, "finish_records"), "bid_id", "area_sf", "ceiling_height_ft", "floor_finish")


@query("""
with b as (select bundle_id, sheet_type, pdf_name, full_text from bundles where not starts_with(upper(pdf_name), 'DO_NOT_USE')) select sheet_type, count(*) n from b where coalesce(sheet_type, 'unknown') <> 'unknown' group by 1
""")
def whole_documents(spark: SparkSession, folder: str) -> DataFrame:
    whole, _ = classify.split_documents(load(spark, folder, "bundles"), "pdf_name", "sheet_type")
    return whole.groupBy("sheet_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
with d as (select doc_id, bid_id, source, lang, text from documents) select doc_id, coalesce(trim(bid_id), '') <> '' or coalesce(trim(source), '') <> '' or coalesce(trim(lang), '') <> '' or coalesce(trim(text), '') <> '' has_content from d
""")
def has_content(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", reports.any_filled("bid_id", "source", "lang", "text").alias("has_content"))


_LOG = "select bid_id, mark, width_raw, extracted_at, record_id from door_records where width_raw is not null and bid_id is not null and mark is not null"


@query(f"""
with l as ({_LOG}), g as (select bid_id || ':' || mark door, list(width_raw order by extracted_at, record_id) h from l group by 1) select door, h[-2] current, h[-3] before, array_to_string(h[greatest(1, len(h) - 10) : len(h) - 1], '|') history from g where len(h) > 1
""")
def override_revert(spark: SparkSession, folder: str) -> DataFrame:
    """State after the last change of each door's width is taken back."""
    log = load(spark, folder, "door_records").where("width_raw is not null and bid_id is not null and mark is not null")
    rows = log.select(F.concat_ws(":", "bid_id", "mark").alias("door"), F.struct("extracted_at", "record_id").alias("at"), "width_raw")
    last = rows.groupBy("door").agg(F.max("at").alias("last"))
    kept = rows.join(last, "door").where("at < last").drop("last")
    return records.replay(kept, "door", "at", "width_raw").select("door", "current", "before", F.array_join("history", "|").alias("history"))


@query("""
with v as (select v.row_id, v.unit_cost, v.received_at, t.item_id from vendor_rows v join takeoff_template t on t.item_id = v.row_id % 1000 and t.list_name = 'line_items' where v.unit_cost is not null)
select item_id, arg_max(unit_cost, struct_pack(a := received_at, b := row_id)) unit_cost, count(*) n_applied from v group by 1
""")
def apply_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Two quote rows may price one line: the last one counts (rows go to lines by number here)."""
    lines = load(spark, folder, "takeoff_template").where("list_name = 'line_items'").select("item_id")
    rows = load(spark, folder, "vendor_rows").where("unit_cost is not null").select((F.col("row_id") % 1000).alias("item_id"), "unit_cost", F.struct("received_at", "row_id").alias("at"))
    return rollups.last_per_key(rows.join(lines, "item_id", "left_semi"), "item_id", "at").select("item_id", "unit_cost", F.col("n_rows").alias("n_applied"))


@query("""
with d as (select bid_id, room_number room, width_in w, height_in h, record_id % 4 = 0 win from door_records), k as (select distinct bid_id, room_number room from finish_records where bid_id is not null and room_number is not null)
select d.bid_id, d.room, count(*) n_openings, sum(coalesce(w * h / 144, case when win then 12 else 21 end)::decimal(18,6))::double opening_sf from d join k on k.bid_id = d.bid_id and k.room = d.room group by 1, 2
""")
def openings_with_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Openings of rooms, windows (every fourth record here) among them."""
    rows = load(spark, folder, "door_records").select("record_id", "bid_id", F.col("room_number").alias("room"), "width_in", "height_in")
    rooms = load(spark, folder, "finish_records").select("bid_id", F.col("room_number").alias("room"))
    window = F.col("record_id") % 4 == 0
    return lookups.openings_by_room(rows.where(~window), rooms, rows.where(window))


@query("""
select event_type series, arg_max("value", struct_pack(a := ts, b := strftime(ts, '%Y-%m-%d'), c := "value")) as "value", strftime(ts, '%Y-%m-%d') period from events group by 1, 3
""")
def snapshot_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "events").select(F.lit("own").alias("source"), F.col("event_type").alias("series"), F.col("ts").alias("fetched_at"), F.date_format("ts", "yyyy-MM-dd").alias("period"), "value")
    return files.history(rows).select("series", "period", "value")


_SUPPORT = (
    "wage determination|wage decision|wage rates|prevailing wage|davis-bacon|davis bacon|dba wd|dbra| wd |tx2026|tx 2026|tax exemption|tax-exempt|tax exempt certificate|sales tax|sample agreement|sample contract|template agreement|csa template|"
    "sample construction services agreement|construction services agreement|hub subcontracting plan|subcontracting plan form|hsp form| hsp |ugsc|uniform general conditions|supplementary general conditions|instructions to bidders|instructions to offerors|aia document"
)
_SUPPORT_KINDS = (
    "wage determination > wage determination, wage decision > wage determination, davis-bacon > wage determination, davis bacon > wage determination, prevailing wage > wage determination, wage rates > wage determination, "
    "tax exemption > tax exemption certificate, tax-exempt > tax exemption certificate, sales tax > tax exemption certificate, sample agreement > sample agreement, sample contract > sample agreement, "
    "sample construction services agreement > sample agreement, template agreement > sample agreement, csa template > sample agreement, hub subcontracting plan > HSP form, subcontracting plan > HSP form, hsp > HSP form, ugsc > UGSC, "
    "uniform general conditions > UGSC, supplementary general conditions > UGSC, instructions to bidders > instructions to bidders, instructions to offerors > instructions to bidders, aia document > AIA template"
)


@query(f"""
with h as (select doc_id, lower(coalesce(source, '') || ' ' || left(coalesce(text, ''), 2000)) t, lower(concat_ws(' ', source, text)) w from documents)
select doc_id, len(list_filter(string_split('{_SUPPORT}', '|'), lambda p: contains(t, p))) > 0 supporting, case {" ".join(f"when contains(w, '{k}') then '{v}'" for k, v in (x.split(" > ") for x in _SUPPORT_KINDS.split(", ")))} else 'other' end kind from h
""")
def supporting_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "documents")
    return rows.select("doc_id", classify.is_supporting(F.col("source"), F.col("text")).alias("supporting"), classify.supporting_kind(F.col("source"), F.col("text")).alias("kind"))


@query("""
with p as (select line_id, csi_division d, coalesce(unit_cost, 0) l, coalesce(total_cost, 0) m, coalesce(quantity, 0) e, ['cwicr:' || line_id, '(no match)', csi_section, null][(line_id % 4) + 1] src from price_sheet)
select line_id, case d when '03' then 1.07 when '04' then 1.08 when '05' then 1.03 when '06' then 1.1 when '07' then 1.07 when '08' then 1.02 when '09' then 1.1 when '31' then 1.05 when '32' then 1.05 else 1.0 end::double waste,
  case when d = '01' then 'other' when d = '06' then 'labor' when d in ('08', '10') then 'material' when d = '11' then 'equipment' when d in ('02', '03', '04', '05', '07', '09', '21', '22', '23', '26', '31', '32', '33') then 'subcontractor'
  when greatest(l, m, e) <= 0 then 'subcontractor' when l = greatest(l, m, e) then 'labor' when m = greatest(l, m, e) then 'material' else 'equipment' end category,
  case when starts_with(coalesce(src, ''), 'cwicr:') then 'cwicr' when coalesce(src, '') in ('', '(no match)') then 'no match' else 'seed' end family from p
""")
def line_categories(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "price_sheet")
    source = F.get(F.array(F.concat(F.lit("cwicr:"), F.col("line_id").cast("string")), F.lit("(no match)"), F.col("csi_section"), F.lit(None)), (F.col("line_id") % 4).cast("int"))
    category = classify.cost_category(F.col("csi_division"), F.col("unit_cost"), F.col("total_cost"), F.col("quantity"))
    return rows.select("line_id", classify.waste_factor(F.col("csi_division")).alias("waste"), category.alias("category"), classify.source_family(source).alias("family"))


@query("""
with n as (select row_id, coalesce(trim(notes, ' '), '') p, '[batch] operator override: row ' || row_id h from vendor_rows), o as (select row_id, h, case when p = '' then h else h || ' | previous: ' || p end a from n)
select row_id, a once, a twice, regexp_extract(a, '^(\\[[a-z][a-z\\-]*\\])\\s', 1) tag from o
""")
def tagged_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with a tag put first, and the same once more: nothing changes."""
    rows = load(spark, folder, "vendor_rows")
    note = F.concat(F.lit("[batch] row "), F.col("row_id").cast("string"))
    once = rows.select("row_id", note.alias("note"), classify.tag_first("[batch]", note, F.col("notes")).alias("once"))
    return once.select("row_id", "once", classify.tag_first("[batch]", F.col("note"), F.col("once")).alias("twice"), classify.leading_tag(F.col("once")).alias("tag"))
