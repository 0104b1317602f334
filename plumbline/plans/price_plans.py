"""Queries of catalogue matches, match plans and price series, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups, matching, units
from ..sources.tables import load
from .registry import Registry

_REGISTRY = Registry()
query, queries, oracle_sql = _REGISTRY.query, _REGISTRY.queries, _REGISTRY.oracle_sql


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    """The stated set of queries: every fiftieth takeoff line."""
    lines = load(spark, folder, "takeoff_template").where("list_name = 'line_items' and item_id % 50 = 0")
    return lines.select(F.col("item_id").alias("wanted_id"), "description", "unit", F.col("csi_section").alias("section"))


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "price_sheet").where("description is not null")
    return rows.select(F.col("line_id").alias("row_id"), F.col("csi_section").alias("code"), "description", "unit", F.col("cost_category").alias("category"))


@query()
def catalogue_match(spark: SparkSession, folder: str) -> DataFrame:
    """Best five catalogue rows of every fiftieth takeoff line (tested against brute force)."""
    return matching.catalogue_match(_wanted(spark, folder), _catalogue(spark, folder))


@query()
def layered_prices(spark: SparkSession, folder: str) -> DataFrame:
    wanted = _wanted(spark, folder)
    seeds = load(spark, folder, "price_sheet").where("csi_section is not null").select(F.col("csi_section").alias("section"), F.col("line_id").alias("entry_id"))
    return matching.layered_price(wanted, matching.catalogue_match(wanted, _catalogue(spark, folder)), seeds)


@query()
def vendor_match_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Match plan of every fiftieth quote row against all takeoff lines (tested against brute force)."""
    table = F.broadcast(units.conversion_table(spark).where("family = 'material'").select("alias", F.col("unit").alias("canonical")))
    coded = lambda df, key, unit: df.select(F.col(key).alias("row_id"), "description", "quantity", units.normal_unit(F.col(unit)).alias("alias")).join(table, "alias", "left").select("row_id", "description", "quantity", F.col("canonical").alias("unit"))
    rows = coded(load(spark, folder, "vendor_rows").where("row_id % 50 = 0"), "row_id", "unit_of_measure")
    lines = coded(load(spark, folder, "takeoff_template").where("list_name = 'line_items'"), "item_id", "unit").withColumnRenamed("row_id", "line_id")
    return matching.match_plan(rows, lines).withColumn("candidates", F.array_join("candidates", ","))


_UNIT_PAIRS = [
    (1, "LF", "linear ft", 1.1), (2, "100 m", "meter", 1.1), (3, "sq ft", "m2", 0.85), (4, "EA", "each", 1.1), (5, "ea", "lf", 0.55), (6, None, "lf", 1.0), (7, "", " ", 1.0), (8, "cu yd", "CUM", 0.85), (9, "tons", "kg", 0.85),
    (10, "roll", "roll", 1.1), (11, "roll", "ea", 0.55), (12, "Lump  Sum", "ls", 1.1), (13, "hour", "each", 0.55),
]


@query("select * from (values " + ", ".join(f"({i}, {f}::double)" for i, _, _, f in _UNIT_PAIRS) + ") t(pair_no, factor)")
def unit_factors(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([r[:3] for r in _UNIT_PAIRS], "pair_no int, a string, b string")
    return rows.select("pair_no", matching.unit_factor(F.col("a"), F.col("b")).alias("factor"))


@query("""
with p as (select line_id, regexp_replace(coalesce(csi_section, ''), '[^0-9]', '', 'g')[1:2] d, lower(coalesce(description, '')) t from price_sheet),
w(d, w) as (values ('03', 'concrete'), ('03', 'reinforced'), ('03', 'rebar'), ('03', 'formwork'), ('03', 'slab'), ('03', 'footing'), ('08', 'door'), ('08', 'window'), ('08', 'opening'), ('08', 'glazing'), ('08', 'hardware'),
  ('09', 'finishes'), ('09', 'drywall'), ('09', 'gypsum'), ('09', 'plaster'), ('09', 'tile'), ('09', 'flooring'), ('09', 'paint'), ('09', 'ceiling'), ('22', 'plumbing'), ('22', 'water'), ('22', 'sewer'), ('22', 'fixture'), ('22', 'pipe'),
  ('23', 'hvac'), ('23', 'heating'), ('23', 'ventilation'), ('23', 'ductwork'), ('23', 'air handler'), ('26', 'electrical'), ('26', 'wiring'), ('26', 'conduit'), ('26', 'luminaire'), ('26', 'panel'))
select line_id, least(0.05, 0.015 * count(w.w))::double bonus from p left join w on w.d = p.d and contains(p.t, w.w) where p.d in ('03', '08', '09', '22', '23', '26') group by 1
""")
def hint_bonuses(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "price_sheet")
    digits = F.left(F.regexp_replace(F.coalesce("csi_section", F.lit("")), r"\D", ""), F.lit(2))
    return rows.where(digits.isin("03", "08", "09", "22", "23", "26")).select("line_id", matching.hint_bonus(F.col("csi_section"), F.col("description")).alias("bonus"))


_AGREE = [(1, "LS", "LOT", True), (2, "EA", "SET", True), (3, "SET", "PR", False), (4, "EA", "PR", True), (5, "LF", "SF", False), (6, None, "SF", True), (7, None, None, True), (8, "CY", "CY", True)]


@query("select * from (values " + ", ".join(f"({i}, {str(v).lower()})" for i, _, _, v in _AGREE) + ") t(pair_no, agree)")
def unit_agreement(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([r[:3] for r in _AGREE], "pair_no int, a string, b string")
    return rows.select("pair_no", matching.units_agree(F.col("a"), F.col("b")).alias("agree"))


_BY_SECTION = (
    "06 10 00 WPU0811, 06 16 00 WPU0814, 06 41 00 WPU0812, 09 29 00 WPU102201, 09 91 23 WPU065, 07 31 13 WPU1351, 07 41 13 WPU1017, 05 12 00 WPU101707, 05 31 00 WPU1017, 26 05 00 WPU102301, 26 24 16 WPU102301, 22 11 00 WPU062, "
    "22 40 00 WPU2025201, 03 30 00 WPU132, 03 31 00 WPU132, 03 35 00 WPU132, 04 22 00 WPU132, 32 12 16 WPU1351, 32 13 13 WPU132"
)
_BY_WORD = (
    "concrete masonry WPU132, ready-mix concrete WPU132, structural steel WPU101707, plywood WPU0814, hardwood WPU0812, softwood WPU0811, lumber WPU0811, framing WPU0811, drywall WPU102201, gypsum WPU102201, paint WPU065, coatings WPU065, "
    "wire WPU102301, conduit WPU102301, electrical WPU102301, plumbing WPU2025201, pvc WPU062, asphalt shingle WPU1351, asphalt WPU1351, metal roof WPU1017, metal deck WPU1017, steel WPU1017, diesel WPU057303, fuel WPU057303, "
    "sidewalk WPU132, concrete WPU132, insulation WPUSI012011, hardware WPU2025201"
)
_BY_DIVISION = (
    "01 WPUSI012011, 02 WPUSI012011, 03 WPU132, 04 WPU132, 05 WPU1017, 06 WPU0811, 07 WPU1351, 08 WPU2025201, 09 WPU102201, 10 WPUSI012011, 11 WPUSI012011, 12 WPUSI012011, 13 WPUSI012011, 14 WPUSI012011, 21 WPU102301, 22 WPU2025201, "
    "23 WPUSI012011, 26 WPU102301, 27 WPU102301, 28 WPU102301, 31 WPU132, 32 WPU132, 33 WPU062"
)


def _values(text: str) -> str:
    return ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(x.rsplit(" ", 1) for x in text.split(", ")))


@query(f"""
with s(r, k, v) as (values {_values(_BY_SECTION)}), w(r, k, v) as (values {_values(_BY_WORD)}), d(r, k, v) as (values {_values(_BY_DIVISION)}),
l as (select item_id, csi_section, lower(coalesce(description, '')) t from takeoff_template), h as (select item_id, arg_min(w.v, w.r) v from l join w on contains(l.t, w.k) group by 1)
select l.item_id, coalesce(s.v, h.v, d.v, 'WPUSI012011') series from l left join s on s.k = l.csi_section left join h on h.item_id = l.item_id left join d on d.k = left(l.csi_section, 2)
""")
def price_series(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "takeoff_template").select("item_id", matching.price_series(F.col("csi_section"), F.col("description")).alias("series"))


_SERIES = "select event_type series, strftime(ts, '%Y-%m-%d') period, arg_max(value, struct_pack(a := ts, b := event_id)) as value from events group by 1, 2"
_ASKED = [("click", "2024-01-05", "2024-01-20"), ("unheard_of", "2024-01-05", "2024-01-20"), ("view", "2024-01-02", "2024-02-01")]


@query(f"""
with s as ({_SERIES}), a(series, base, target) as (values {", ".join(f"('{s}', '{b}', '{t}')" for s, b, t in _ASKED)}), u as (select *, case when exists (select 1 from s where s.series = a.series) then a.series else 'purchase' end used from a),
v as (select u.*, (select value from s where s.series = used and period <= base order by period desc limit 1) b0, (select value from s where s.series = used and period <= target order by period desc limit 1) t0,
  (select value from s where s.series = used order by period limit 1) o0 from u)
select series, base, target, coalesce(round((coalesce(t0, o0) / nullif(coalesce(b0, o0), 0))::decimal(18,6), 4)::double, 1.0) factor from v
""")
def change_with_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Change factors; a series without values takes the fallback series."""
    events = load(spark, folder, "events").select(F.col("event_type").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("period"), "value", "ts", "event_id")
    series = events.groupBy("series", "period").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return lookups.change_factor(series, spark.createDataFrame(_ASKED, "series string, base string, target string"), fallback="purchase")
