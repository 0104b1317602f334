"""Best representative of each group of duplicate records.

Groups are found by keys brought to one spelling. In each group one existing record is kept (the most complete,
then the latest, ...), and every field gets a consensus value: the group's distinct values, weighted by how often
and how surely they were read, are aligned token by token, the heaviest first, to a growing profile; the tokens of
each column vote with their weights, and the existing value closest to the winning tokens is the consensus. Holes of
the kept record are filled with it. Only fields without a clear majority are aligned. Values of a field are gathered
BLOCK at a time and the profiles of blocks are merged level by level, so no group is ever gathered in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import counted_lookup
from ..session import cut
from ..sources.tables import need

#: Stand-ins for an unknown value (compared in lower case without outer blanks).
STAND_INS = ("", "-", "--", "---", "?", "??", "n/a", "na", "n.a.", "tbd", "t.b.d.", "tbc", "unk", "unknown", "none", "null", "nil", "not given", "not shown", "x", "xx", "xxx", ".", "*")

#: Values, or profiles, of one set that are aligned in one task.
BLOCK = 64
#: Cells of an alignment whose directions are kept; larger ones are halved first, so that memory stays linear.
CELLS = 1 << 23
#: Costs of aligning two tokens that differ, and a token with a gap.
DIFFERS, GAP = 1.5, 1.0

@dataclass(frozen=True)
class Spec:
    """How records of one table are grouped and ranked."""

    tab: str
    fields: tuple[str, ...]
    key: str
    split: str | None  # a second key in which null differs from nothing
    key_kind: str
    weight: str = "confidence"
    latest: str = "extracted_at"
    page: str = "source_page"


DOORS = Spec(
    "door_records",
    ("door_type", "width_in", "height_in", "thickness_in", "width_raw", "height_raw", "material", "frame", "hardware_set", "fire_rating", "remarks"),
    "mark",
    "room_number",
    "mark",
)
FINISHES = Spec(
    "finish_records",
    ("room_name", "floor_finish", "base_finish", "wall_finishes", "ceiling_finish", "ceiling_height_ft", "ceiling_height_raw", "area_sf", "remarks"),
    "room_number",
    None,
    "room",
)


def one_spelling(text: Column, kind: str) -> Column:
    """A door mark or room number in one spelling, null if nothing is left of it.

    Case, blanks, punctuation and the words for door or room don't matter; a letter O read for a zero beside
    digits counts as zero. Parts of a room number (building and room) stay apart.
    """
    up = F.trim(F.regexp_replace(F.upper(F.regexp_replace(text, r"[\x{200b}-\x{200f}\x{2060}\x{feff}\x{ad}]", "")), r"[\s\x{a0}]+", " "))
    if kind == "mark":
        bare = F.regexp_replace(up, r"^[^A-Z0-9]*(?:DOOR|DR|D(?=[^A-Z0-9]*[A-Z]?[0-9]))(?:\s*(?:NO|NUMBER|MARK)\b)?", "")
        joined = F.regexp_replace(bare, r"[^A-Z0-9]+", "")
    else:
        bare = F.regexp_replace(up, r"^[^A-Z0-9]*(?:ROOM|RM|R(?=[^A-Z0-9]))(?:\s*(?:NO|NUMBER)\b)?", "")
        joined = F.regexp_replace(F.regexp_replace(bare, r"[^A-Z0-9]+", "-"), r"^-+|-+$", "")
    zeroed = F.regexp_replace(joined, r"(?<=[0-9])O|O(?=[0-9])", "0")
    return F.nullif(zeroed, F.lit(""))


#: A text of nothing but blanks and at most one stand-in.
_UNKNOWN = r"(?i)^[\s\x{a0}]*(?:" + "|".join(re.escape(s).replace("\\ ", r"[\s\x{a0}]+") for s in STAND_INS if s) + r")?[\s\x{a0}]*$"


def filled_text(name: str, kind: T.DataType) -> Column:
    """Text of a field, null where it is null, blank, empty or a stand-in for an unknown value."""
    column = F.col(f"`{name}`")
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.filter(F.map_entries(column), lambda e: ~F.lower(F.trim(F.coalesce(e["value"].cast("string"), F.lit("")))).isin(*STAND_INS)))
        return F.when(F.size(entries) > 0, F.to_json(entries))
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(column) > 0, F.to_json(column))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(column.isNotNull() & ~F.isnan(column), column.cast("string"))
    text = column.cast("string")
    return F.when(~text.rlike(_UNKNOWN), text)


_TOKEN = re.compile(r"\w+|[^\w\s]")
_TINY = 1e-9



def tokens(text: str) -> list[str]:
    """Words and single other characters, lower case."""
    return _TOKEN.findall(text.lower())


@dataclass
class Profile:
    """Aligned values: the weights of the tokens in each column and the weight of all values; the rest of it are gaps."""

    columns: list[dict[str, float]]
    whole: float

    @classmethod
    def of(cls, value: str, weight: float) -> Profile:
        return cls([{t: weight} for t in tokens(value)], weight)

    def filled(self) -> np.ndarray:
        """Share of the weight that has a token, by column."""
        return np.array([sum(c.values()) for c in self.columns]) / self.whole

    def merged(self, other: Profile) -> Profile:
        columns = []
        for i, j in path(self, other):
            left, right = self.columns[i] if i is not None else {}, other.columns[j] if j is not None else {}
            columns.append({t: left.get(t, 0.0) + right.get(t, 0.0) for t in {**left, **right}})
        return Profile(columns, self.whole + other.whole)

    def winners(self) -> list[str]:
        """The token with most weight of each column, the larger on a tie, columns in which gaps win left out."""
        best = (max([(round(self.whole - sum(c.values()), 6), ""), *((round(w, 6), t) for t, w in c.items())]) for c in self.columns)
        return [t for _, t in best if t]


class _Costs:
    """Expected costs of aligning columns of two profiles, and the rows of the table of least costs."""

    def __init__(self, a: Profile, b: Profile) -> None:
        self.a, self.whole = a, a.whole * b.whole
        self.fill_a, self.fill_b = a.filled(), b.filled()
        at: dict[str, tuple[list[int], list[float]]] = {}
        for j, c in enumerate(b.columns):
            for t, w in c.items():
                places, weights = at.setdefault(t, ([], []))
                places.append(j)
                weights.append(w)
        self.at = {t: (np.array(p), np.array(w)) for t, (p, w) in at.items()}

    def meet(self, i: int, low: int, high: int) -> np.ndarray:
        """Cost of column i of a beside each of the columns low to high of b."""
        fill, others = self.fill_a[i], self.fill_b[low:high]
        equal = np.zeros(len(self.fill_b))
        for t, w in self.a.columns[i].items():
            if t in self.at:
                places, weights = self.at[t]
                equal[places] += w * weights / self.whole
        return DIFFERS * (fill * others - equal[low:high]) + GAP * (fill * (1 - others) + (1 - fill) * others)

    def rows(self, rows: range, low: int, high: int, keep: np.ndarray | None = None) -> np.ndarray:
        """Least costs of the columns low to j of b against all of `rows` of a, in their order (b runs backwards where they do)."""
        back = rows.step < 0
        fill = self.fill_b[low:high][::-1] if back else self.fill_b[low:high]
        alone = np.concatenate(([0.0], np.cumsum(GAP * fill)))
        last = alone.copy()
        for n, i in enumerate(rows):
            meet = self.meet(i, low, high)
            beside, over = last[:-1] + (meet[::-1] if back else meet), last + GAP * self.fill_a[i]
            best = over.copy()
            best[1:] = np.minimum(beside, over[1:])
            last = np.minimum.accumulate(best - alone) + alone
            if keep is not None:  # 0 beside each other, 1 over a gap in b, 2 a gap in a
                keep[n, 1:] = np.where(last[1:] < best[1:] - _TINY, 2, np.where(beside <= over[1:] + _TINY, 0, 1))
                keep[n, 0] = 1
        return last


def path(a: Profile, b: Profile) -> list[tuple[int | None, int | None]]:
    """Columns of two profiles side by side at the least expected cost; None is a gap."""
    costs = _Costs(a, b)
    found: list[tuple[int | None, int | None]] = []
    todo = [(0, len(a.columns), 0, len(b.columns))]
    while todo:
        top, bottom, low, high = todo.pop()
        n, m = bottom - top, high - low
        if n * m > CELLS and n > 1:  # where the best path crosses the middle
            middle = top + n // 2
            sums = costs.rows(range(top, middle), low, high) + costs.rows(range(bottom - 1, middle - 1, -1), low, high)[::-1]
            at = low + int(np.argmin(sums))
            todo += [(middle, bottom, at, high), (top, middle, low, at)]
            continue
        keep = np.zeros((n, m + 1), dtype=np.int8)
        costs.rows(range(top, bottom), low, high, keep)
        i, j, part = n, m, []
        while i or j:
            move = keep[i - 1, j] if i else 2
            i, j = i - (move != 2), j - (move != 1)
            part.append((top + i if move != 2 else None, low + j if move != 1 else None))
        found += reversed(part)
    return found


def distance(value: str, won: list[str]) -> float:
    """Cost of aligning a value with tokens, 1 for a token too many or too few, 1.5 for another one."""
    a = Profile.of(value, 1.0)
    b = Profile([{t: 1.0} for t in won], 1.0)
    if a.columns == b.columns:
        return 0.0
    return round(float(_Costs(a, b).rows(range(len(a.columns)), 0, len(won))[-1]), 6)


def profile_of(values: list[tuple[float, str]]) -> Profile:
    """Profile of values (weight, value), the heaviest first, on a tie the larger one."""
    return reduce(Profile.merged, (Profile.of(v, w) for w, v in sorted(values, reverse=True)))


def settle(values: list[tuple[float, str]]) -> str:
    """The value closest to the consensus of all, on a tie the heavier, then the smaller one."""
    won = profile_of(values).winners()
    return min(values, key=lambda x: (distance(x[1], won), -x[0], x[1]))[1]


def _listed(value) -> list[tuple[float, str]]:
    return [(float(x["weight"]), x["value"]) for x in value]


@F.pandas_udf(T.StringType())
def settled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for sets in batches:
        yield pd.Series([settle(_listed(s)) for s in sets], dtype=object)


def _packed(first: float, profile: Profile) -> str:
    return json.dumps([first, profile.whole, profile.columns], sort_keys=True)


@F.pandas_udf(T.StringType())
def profiled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Profiles of blocks of values as JSON, with the weight of the heaviest."""
    for sets in batches:
        yield pd.Series([_packed(max(w for w, _ in v), profile_of(v)) for v in map(_listed, sets)], dtype=object)


@F.pandas_udf(T.StringType())
def together(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Profiles of blocks of profiles, in the order of their heaviest values."""
    for sets in batches:
        merged = []
        for found in sets:
            parts = sorted((json.loads(x) for x in found), key=lambda x: (-x[0], -x[1], str(x[2])))
            merged.append(_packed(parts[0][0], reduce(Profile.merged, (Profile(columns, whole) for _, whole, columns in parts))))
        yield pd.Series(merged, dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def won_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in batches:
        yield pd.Series([Profile(columns, whole).winners() for _, whole, columns in map(json.loads, part)], dtype=object)


@F.pandas_udf(T.DoubleType())
def far_from(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for values, won in batches:
        yield pd.Series([distance(v, list(w)) for v, w in zip(values, won)], dtype="float64")


def consensus(values: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Consensus of each set of values: `keys`, value.

    values: `keys`, value (not null), weight; equal values may repeat. On equal distance the heavier value wins,
    then the smaller one. A value with more than half of the weight wins every column, so such sets are settled
    without alignment. Sets of more than `block` distinct values are cut into blocks by a hash; each gives a profile,
    and profiles are merged `block` at a time, level by level.
    """
    distinct = values.groupBy(*keys, "value").agg(F.sum("weight").alias("weight"))
    sets = distinct.groupBy(*keys).agg(F.max(F.struct("weight", "value")).alias("top"), F.sum("weight").alias("whole"), F.count(F.lit(1)).alias("n"))
    clear = F.col("top.weight") * 2 > F.col("whole")
    alone = sets.where(clear).select(*keys, F.col("top.value").alias("value"))
    unclear = cut(sets.where(~clear).select(*keys, "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    unsettled = counted_lookup(distinct, unclear, keys, "n")
    listed = F.collect_list(F.struct("weight", "value"))  # of one block
    few = unsettled.where("blocks = 1").groupBy(*keys).agg(listed.alias("listed")).select(*keys, settled("listed").alias("value"))
    found = alone.unionByName(few)
    most = unclear.agg(F.max("blocks")).first()[0] or 1
    if most == 1:
        return found
    many = cut(unsettled.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int")))
    state = many.groupBy(*keys, "block").agg(listed.alias("listed")).select(*keys, "block", profiled("listed").alias("p"))
    while most > 1:
        most = -(-most // block)
        state = state.groupBy(*keys, F.floor(F.col("block") / block).cast("int").alias("block")).agg(F.collect_list("p").alias("ps")).select(*keys, "block", together("ps").alias("p"))
    won = state.select(*keys, won_tokens("p").alias("won"))
    scored = counted_lookup(many, won.join(unclear.select(*keys, "n"), keys), keys, "n")
    best = scored.groupBy(*keys).agg(F.min(F.struct(far_from("value", "won").alias("far"), (-F.col("weight")).alias("lighter"), "value"))["value"].alias("value"))
    return found.unionByName(best)


def _rows(df: DataFrame, spec: Spec, width: int) -> DataFrame:
    """Records of a table with their keys in one spelling: tab, record_id, bid_id, key, room, texts (how the key is
    written, then the fields, `width` in all), latest, page, weight."""
    kinds = {f.name: f.dataType for f in df.schema}
    columns = ["record_id", "bid_id", spec.key, *([spec.split] if spec.split else []), *spec.fields, spec.weight, spec.latest, spec.page]
    rows = need(df, *dict.fromkeys(columns))
    texts = [F.trim(F.col(spec.key)), *[filled_text(f, kinds[f]) for f in spec.fields]]
    texts += [F.lit(None).cast("string")] * (width - len(texts))
    return rows.select(
        F.lit(spec.tab).alias("tab"), F.col("record_id").cast("bigint").alias("record_id"), F.col("bid_id").cast("string").alias("bid_id"), one_spelling(F.col(spec.key), spec.key_kind).alias("key"),
        (one_spelling(F.col(spec.split), "room") if spec.split else F.lit(None).cast("string")).alias("room"), F.array(*texts).alias("texts"),
        F.col(spec.latest).cast("timestamp_ntz").alias("latest"), F.col(spec.page).cast("bigint").alias("page"),
        F.when(F.col(spec.weight) > 0, F.col(spec.weight)).otherwise(F.lit(0.01)).cast("decimal(18,6)").alias("weight"),
    ).where("record_id is not null and bid_id is not null and key is not null")


def _parted(rows: DataFrame) -> DataFrame:
    """`rows` with part: with one room or none, all records of a key are one group; with several, those without a room stay by themselves."""
    rooms = rows.groupBy("tab", "bid_id", "key").agg(F.min("room").alias("low"), F.max("room").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    several = rooms.select("tab", "bid_id", "key", F.lit(True).alias("several"), "n")
    return counted_lookup(rows, several, ["tab", "bid_id", "key"], "n", "left").withColumn("part", F.when(F.col("several"), F.coalesce("room", F.lit("?"))).otherwise("")).drop("several", "room")


def best_records(*tables: tuple[DataFrame, Spec]) -> DataFrame:
    """One row per group of two or more records: tab, first_id, keep_id, n_records, written, survivor, agreed.

    written is the consensus spelling of the key; survivor maps each field to the kept record's value or, where that is a hole, to the consensus of the
    others; agreed maps it to the consensus of all. Fields nobody filled are absent. Records without a bid or
    key belong to no group. Of records with a mark used for several rooms, those without a room form one group.
    n_records counts rows; a group whose rows all bear one record_id (a repeated row) is no group of two. All tables
    go through the same few stages.
    """
    keys = ["tab", "bid_id", "key", "part"]
    width = 1 + max(len(spec.fields) for _, spec in tables)
    rows = _parted(cut(reduce(DataFrame.unionByName, [_rows(df, spec, width) for df, spec in tables])))  # keys and texts are made once
    ids = rows.groupBy(*keys).agg(F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("last_id > first_id").drop("last_id")
    members = cut(counted_lookup(rows, ids, keys, "n").select("tab", "first_id", "record_id", "texts", "latest", "page", "weight"))
    filled = F.size(F.filter(F.slice("texts", 2, width), lambda t: t.isNotNull()))
    rank = F.struct(filled.alias("filled"), "latest", "page", (-F.col("record_id")).alias("minus_id"), "texts")
    kept = members.groupBy("tab", "first_id").agg(F.max(rank).alias("kept"), F.count(F.lit(1)).alias("n_records"))
    values = members.select("tab", "first_id", "weight", F.posexplode("texts").alias("at", "value")).where("value is not null")
    agreed = consensus(values, ["tab", "first_id", "at"]).groupBy("tab", "first_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("by_at"))  # at most `width`
    joined = kept.join(agreed, ["tab", "first_id"])  # every group has a consensus, at least of how its key is written
    names = F.coalesce(*[F.when(F.col("tab") == spec.tab, F.array(*map(F.lit, spec.fields))) for _, spec in tables])
    voted = F.transform(F.sequence(F.lit(1), F.lit(width - 1)), lambda i: F.try_element_at("by_at", i))
    own = F.slice("kept.texts", 2, width)

    def as_map(values: Column) -> Column:
        pairs = F.zip_with(names, F.slice(values, F.lit(1), F.size(names)), lambda n, v: F.struct(n.alias("key"), v.alias("value")))
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    return joined.select(
        "tab", "first_id", (-F.col("kept.minus_id")).alias("keep_id"), "n_records", F.try_element_at("by_at", F.lit(0)).alias("written"),
        as_map(F.zip_with(own, voted, lambda x, y: F.coalesce(x, y))).alias("survivor"), as_map(voted).alias("agreed"),
    )
