"""SQL checks of the queries that SQL can express at reasonable cost."""

from __future__ import annotations

from . import survivor

_STAND_INS = ", ".join(f"'{s}'" for s in survivor.STAND_INS)


def _spelling(column: str, kind: str) -> str:
    up = f"trim(regexp_replace(upper({column}), '[\\s\\x{{a0}}]+', ' ', 'g'))"
    if kind == "mark":
        bare = f"regexp_replace(regexp_replace({up}, '^[^A-Z0-9]*(?:DOOR|DR)', ''), '^[^A-Z0-9]*D([^A-Z0-9]*[A-Z]?[0-9])', '\\1')"
        joined = f"regexp_replace({bare}, '[^A-Z0-9]+', '', 'g')"
    else:
        bare = f"regexp_replace(regexp_replace({up}, '^[^A-Z0-9]*(?:ROOM|RM)', ''), '^[^A-Z0-9]*R([^A-Z0-9])', '\\1')"
        joined = f"trim(regexp_replace({bare}, '[^A-Z0-9]+', '-', 'g'), '-')"
    return f"nullif(replace(regexp_replace(regexp_replace({joined}, '([0-9])O', '\\1#', 'g'), 'O([0-9])', '#\\1', 'g'), '#', '0'), '')"


def _filled(text: str) -> str:
    return f"coalesce(lower(trim({text})) not in ({_STAND_INS}), false)::int"


_DOOR_TEXTS = ("door_type", "width_raw", "height_raw", "material", "frame", "hardware_set", "fire_rating", "remarks")
_ROOM_TEXTS = ("room_name", "floor_finish", "base_finish", "ceiling_finish", "ceiling_height_raw", "remarks")
_DOOR_FILLED = " + ".join([*map(_filled, _DOOR_TEXTS), *(f"({c} is not null)::int" for c in ("width_in", "height_in", "thickness_in"))])
_ROOM_FILLED = " + ".join([*map(_filled, _ROOM_TEXTS), *(f"({c} is not null)::int" for c in ("ceiling_height_ft", "area_sf"))]) + (
    f" + (len(list_filter(map_values(wall_finishes), lambda v: coalesce(lower(trim(v)), '') not in ({_STAND_INS}))) > 0)::int"
)

P2 = f"""
with d0 as (select record_id, bid_id, {_spelling("mark", "mark")} k, {_spelling("room_number", "room")} r, {_DOOR_FILLED} n, extracted_at, source_page from door_records),
d1 as (select *, min(r) over (partition by bid_id, k) lo, max(r) over (partition by bid_id, k) hi from d0 where bid_id is not null and k is not null),
f as (select record_id, bid_id, {_spelling("room_number", "room")} k, coalesce({_ROOM_FILLED}, 0) n, extracted_at, source_page from finish_records),
a as (select 'door_records' tab, record_id, bid_id, k, case when lo is not distinct from hi then '' else coalesce(r, '?') end g, n, extracted_at, source_page from d1
  union all select 'finish_records', record_id, bid_id, k, '', n, extracted_at, source_page from f where bid_id is not null and k is not null),
z as (select *, row_number() over (partition by tab, bid_id, k, g order by n desc, extracted_at desc nulls last, source_page desc nulls last, record_id) rn,
  min(record_id) over (partition by tab, bid_id, k, g) first_id, count(*) over (partition by tab, bid_id, k, g) c from a)
select tab, first_id, record_id keep_id from z where rn = 1 and c > 1
"""

P5 = """
with t as (select 'scope_items' tab, scope_id id, text from scope_items union all select 'takeoff_template', item_id, spec_requirements from takeoff_template),
w as (select tab, id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) ws from t where text is not null),
b as (select * from w where len(ws) >= 8), u as (select tab, id, len(ws) n, unnest(ws) word from b),
p as (select a.tab, a.id id_a, b.id id_b, a.n + b.n s, count(*) o from u a join u b on a.tab = b.tab and a.word = b.word and a.id < b.id group by 1, 2, 3, 4)
select tab, id_a, id_b from p where o >= 0.7 * (s - o) - 1e-9
"""

P7 = """
select bundle_id, case when list_max(list_transform(regexp_split_to_array(full_text, '\\s+'), lambda x: length(x))) > 8000 then 'forced' else 'natural' end cut
from bundles where length(full_text) > 8000
"""

_CLEAN = "regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[\\x{ad}\\x{200b}-\\x{200f}\\x{2060}\\x{feff}\\x{fe0f}]', '', 'g'), '([\\p{L}\\p{N}])[-\\x{2010}\\x{2011}][ \\t]*\\r?\\n\\s*([\\p{L}\\p{N}])', '\\1\\2', 'g'), '[\\p{L}\\p{N}]+')"

P9 = f"""
with d as (select doc_id k, {_CLEAN} w from documents where text is not null), i as (select item_id k, {_CLEAN} w from heldout_items where text is not null),
dg as (select distinct k, unnest(list_transform(range(1, len(w) - 10), lambda x: array_to_string(w[x : x + 11], ' '))) g from d where len(w) >= 12),
ig as (select distinct k, unnest(list_transform(range(1, len(w) - 10), lambda x: array_to_string(w[x : x + 11], ' '))) g from i where len(w) >= 12)
select distinct ig.k item_id, dg.k doc_id from ig join dg using (g)
"""

SQL = {"p2_found": P2, "p5_found": P5, "p7_found": P7, "p9_found": P9}
