"""SQL checks of the general data problems."""

from __future__ import annotations

import re

from ..operators import parse_rows, units

_ALIAS_ROWS = ", ".join(f"('{slot}', '{alias}')" for slot, aliases in parse_rows.COLUMN_ALIASES.items() for alias in aliases)
_NUMBER = r"'^\s*\$?\s*([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?\s*$'"

P3 = rf"""
with a(slot, alias) as (values {_ALIAS_ROWS}),
h0 as (select file_name, arg_min(ltrim(raw_line, chr(65279)), line_id) h from vendor_lines where line_no = 1 group by 1),
h1 as (select *, list_transform([',', ';', '|', chr(9)], lambda s: length(h) - length(replace(h, s, ''))) n from h0),
h2 as (select *, [',', ';', '|', chr(9)][list_position(n, list_max(n))] sep from h1),
hc as (select file_name, unnest(string_split(h, sep)) c, generate_subscripts(string_split(h, sep), 1) i from h2),
hs as (select file_name, list(slot order by i) slots from hc left join a on alias = lower(trim(c)) group by 1),
h3 as (select h2.file_name, sep, case when sep = '|' then '\|' else sep end e, slots from h2 join hs using (file_name)),
r as (select l.line_id, coalesce(raw_line, '') raw, sep, slots, '(?:"(?:[^"]|"")*"|[^"' || e || ']*)' cell, e from vendor_lines l join h3 using (file_name) where line_no <> 1),
q as (select *, regexp_full_match(raw, cell || '(?:' || e || cell || ')*', 's') good from r),
c as (select *, case when good then regexp_extract_all(raw || sep, '(' || cell || ')' || e, 1, 's') end cells from q),
v as (select *, list_transform(cells, lambda x: case when left(x, 1) = '"' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) vals from c),
w as (select line_id, good, len(vals) = len(slots) fits, vals[list_position(slots, 'description')] d, vals[list_position(slots, 'unit_cost')] u, coalesce(vals[list_position(slots, 'quantity')], '') n from v)
select line_id, case when not good then 'quoting' when not fits then 'columns' else 'value' end reason from w
where not good or not fits or not regexp_matches(coalesce(d, ''), '\S') or not regexp_matches(coalesce(u, ''), {_NUMBER}) or (regexp_matches(n, '\S') and not regexp_matches(n, {_NUMBER}))
"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_CONVERSIONS = ", ".join(f"('{family}', '{_quoted(a)}', '{u}', {f!r}::double)" for family, a, u, f in units.alias_rows())


def _told(column: str, family: str) -> str:
    names = sorted((a for fam, a, _, _ in units.alias_rows() if fam == family), key=len, reverse=True)
    alternatives = _quoted("|".join(re.escape(a).replace(r"\ ", " ") for a in names))
    cues = r"uom = |given in |counted by |figures are |\(unit: |takeoff in |measured in |numbers |capacity in |rated |values in |column is |reads |serving [a-z ]+ \("
    return f"nullif(regexp_extract(lower({column}), '(?:{cues})({alternatives})(?:[^a-z0-9²³]|$)', 1), '')"


def _alias(unit: str, family: str) -> str:
    given = rf"nullif(regexp_replace(regexp_replace(trim(lower({unit})), '\s+', ' ', 'g'), '[.\s]+$', ''), '')"
    return f"coalesce({given}, {_told('notes', family)}, {_told('description', family)})"


_WIDTH = r"""regexp_replace(regexp_replace(lower(trim(width_raw)), '[’′]', '''', 'g'), '[”″]|''''', '"', 'g')"""
_PART = r"([0-9]+(?:\.[0-9]+)?)"

P4 = rf"""
with m(family, alias, unit, factor) as (values {_CONVERSIONS}),
h as (select *, case when equipment_type in ('AHU', 'VAV', 'FAN') then 'air' when equipment_type = 'PUMP' then 'water' when equipment_type in ('CHILLER', 'BOILER', 'RTU') then 'heat' end f from hvac_records),
a as (select 'takeoff_template' tab, item_id row_id, 'material' family, quantity v, {_alias("unit", "material")} alias from takeoff_template
  union all select 'vendor_rows', row_id, 'material', quantity, {_alias("unit_of_measure", "material")} from vendor_rows
  union all select 'hvac_records', record_id, f, capacity_value, case f when 'air' then {_alias("capacity_unit", "air")} when 'water' then {_alias("capacity_unit", "water")} else {_alias("capacity_unit", "heat")} end from h),
w as (select record_id, {_WIDTH} t from door_records),
x as (select record_id, case
  when regexp_full_match(t, '{_PART} ?(mm|cm|m)\.?') then try_cast(regexp_extract(t, '{_PART}', 1) as double) / case regexp_extract(t, '(mm|cm|m)\.?$', 1) when 'mm' then 25.4 when 'cm' then 2.54 else 0.0254 end
  when regexp_matches(t, '^{_PART} ?(''|ft)') then try_cast(regexp_extract(t, '{_PART}', 1) as double) * 12
    + coalesce(try_cast(nullif(regexp_extract(t, '(?:''|ft\.?) ?-? ?([0-9]+)(?: [0-9]+/[0-9]+)? ?(?:"|in)', 1), '') as double), 0)
    + coalesce(try_cast(nullif(regexp_extract(t, ' ([0-9]+)/[0-9]+ ?(?:"|in)', 1), '') as double) / try_cast(nullif(regexp_extract(t, ' [0-9]+/([0-9]+) ?(?:"|in)', 1), '') as double), 0) end v from w)
select tab, row_id, m.unit, floor(v * factor + 0.5)::bigint whole_qty from a join m using (family, alias) where v is not null and factor <> 1
union all select 'door_records', record_id, 'IN', floor(v + 0.5)::bigint from x where v is not null
"""

SQL = {"p3_found": P3, "p4_found": P4}
