"""Matching of quote rows to takeoff lines that share no key, with a confidence.

Which words stand before places, which follow measures and which are too common to name a maker is learnt from the
texts of both tables. Descriptions are taken apart (maker, product code, size, place, product words) and quantities
brought to common units. Rows with equal parts are one class. Classes that agree in two of the identifying parts are
candidates and get a log-odds from all parts. Since a line has at most one row and a row at most one line, loopy belief propagation runs over
the candidates: every row and every line is a factor that allows one of its pairs, messages pass through joins until
they stand still, and the marginal of a pair is its confidence. Pairs that compete with no other are settled from the
start.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.units import alias_rows, finder
from ..session import cut, forget
from ..sources.tables import need

#: Fixed values, beside what is learnt: words before a number that don't name a maker, what follows a number that is a measure,
#: and words before places.
NOT_MAKERS = frozenset("size type room rm lab gym office ofc storage stor clinic classroom clsrm kitchen restroom stair lobby corridor corr dock vestibule bay psi class of and by at no level phase".split())
_MEASURE = r"\s*(?:in\b(?!-)|in\.|inch|ft\b|mm\b|mil\b|ga\b|lb\b|psi\b|x\b|x\d|by\b|\"|″|”|'|ø|%)"
PLACE_WORDS = "room|rm|@|lab|gym|office|ofc|storage|stor|clinic|classroom|clsrm|kitchen|restroom|rr|toilet rm|stair|lobby|corridor|corr|loading dock|dock|mech room|mech rm|vestibule|shop bay"

_TOLD = re.compile(r"\[[^\]]*\]\s*$")
_PLACE = re.compile(r"(?<![\w.,/#-])(\d)-(\d{3})(?![\w/-])")
_PLACE_JOINED = re.compile(rf"(?:^|(?<=[^\w]))(?:{PLACE_WORDS})\.?\s+(\d{{4}})\b(?!{_MEASURE})")
_CODE = re.compile(rf"\b([^\W\d_]{{3,}})(\s#|-|\s)(\d{{1,6}})(?!\d|[.,/]\d|{_MEASURE})")
_NUMBER = re.compile(r"\d+/\d+|\d+(?:\.\d+)?")
_WORD = re.compile(r"[^\W\d_]{3,}")

#: A word counts as learnt if it occurs this often, and in one of LEXICON texts, so that at most LEXICON times the words of a
#: text are learnt, and if this share of what is asked (numbers after it that are places, numbers before it) holds.
LEARNT_COUNT, LEXICON, LEARNT_SHARE = 3, 20_000, 0.8
#: Words in more than one of so many texts are too common for a maker, where another word will do.
COMMON_TEXTS = 500

#: Log-odds of a pair before anything is compared, and what each part adds: (agrees, nearly or in part, differs).
PRIOR = -6.0
CODE, MAKER, PLACE, SIZE, QUANTITY = (4.0, -4.0), (4.0, 2.5, -4.0), (5.0, -9.0), (3.0, 1.0, -5.0), (3.0, -5.0)
DIMENSION_DIFFERS, WORDS = -6.0, 2.0
#: Share of letters by which makers may differ and still be nearly the same; relative difference of equal quantities.
MAKER_NEAR, QUANTITY_NEAR = 0.4, 0.03
#: Messages stand still below this change; share of its last value that a message keeps.
STILL, DAMPING = 1e-3, 0.2

_PARTS = T.StructType([
    T.StructField("maker", T.StringType()), T.StructField("code", T.StringType()), T.StructField("place", T.StringType()), T.StructField("size", T.ArrayType(T.StringType())),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("dimension", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("slack", T.DoubleType()),
])

_ALIASES = {alias: (unit, factor) for family, alias, unit, factor in alias_rows() if family == "material"}


@dataclass(frozen=True)
class Lexicon:
    """Words learnt from the texts: those before places, those that follow measures, those too common for a maker."""

    places: frozenset[str] = frozenset()
    measures: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()


_BEFORE = re.compile(r"([^\W\d_]{2,})\.?\s+(?:(\d-\d{3})|(\d{4})|#?\d+)(?![\w/-])")
_AFTER = re.compile(r"(?<![\w/-])\d+(?:[./]\d+)?\s*([^\W\d_]{2,})\b")


def learn(*tables: DataFrame) -> Lexicon:
    """Lexicon from the descriptions of all rows: `Auditorium 5-375` tells a place, `40 hp` a measure. Equal descriptions are one text,
    or a single misread one would become a rule by being repeated."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            before: Counter[str] = Counter()
            dashed: Counter[str] = Counter()
            places: Counter[str] = Counter()
            after: Counter[str] = Counter()
            texts: Counter[str] = Counter({"": len(batch)})
            for text in batch["description"]:
                text = text.lower()
                for word, dash, four in _BEFORE.findall(text):
                    before[word] += 1
                    if dash:
                        dashed[word] += 1
                    if dash or four:
                        places[word] += 1
                follow = _AFTER.findall(text)
                after.update(follow)
                texts.update({*_WORD.findall(text), *follow})
            words = list(texts.keys() | before.keys())
            yield pd.DataFrame({"word": words} | {f"k{i}": [c[w] for w in words] for i, c in enumerate((before, dashed, places, after, texts))})

    spark = tables[0].sparkSession
    texts = None
    for t in tables:
        part = t.select("description").where("description is not null")
        texts = part if texts is None else texts.unionByName(part)
    kinds = [f"k{i}" for i in range(5)]
    sums = cut(texts.distinct().mapInPandas(count, "word string, " + ", ".join(f"{k} bigint" for k in kinds)).groupBy("word").agg(*[F.sum(k).alias(k) for k in kinds]))
    whole = sums.where("word = ''").select("k4").first()
    least = max(LEARNT_COUNT, (whole[0] if whole else 0) // LEXICON)
    kept = sums.where((F.col("word") != "") & ((F.col("k1") >= least) | (F.col("k3") >= least) | (F.col("k4") > max(least, (whole[0] if whole else 0) // COMMON_TEXTS)))).collect()
    forget(spark, sums)
    places = frozenset(r.word for r in kept if r.k1 >= least and r.k2 >= LEARNT_SHARE * r.k0)
    measures = frozenset(r.word for r in kept if r.k3 >= least and r.k3 >= LEARNT_SHARE * r.k4) - NOT_MAKERS - places
    common = frozenset(r.word for r in kept if r.k4 > max(least, (whole[0] if whole else 0) // COMMON_TEXTS))
    return Lexicon(places, measures, common - places)


def take_apart(description: str | None, known: Lexicon = Lexicon()) -> tuple[str | None, str | None, str | None, list[str], list[str]]:
    """Maker, product code, place (four digits), numbers of the size, product words of a description."""
    text = _TOLD.sub("", (description or "").lower())
    place = None
    found = list(_PLACE.finditer(text))
    if found:
        place = found[-1][1] + found[-1][2]
        text = text[: found[-1].start()] + " " + text[found[-1].end() :]
    else:
        spans = [m.span(1) for m in _PLACE_JOINED.finditer(text)] or [m.span(3) for m in _BEFORE.finditer(text) if m[3] and m[1] in known.places and not _measured(text, m.end(3), known)]
        if spans:
            start, end = max(spans)
            place = text[start:end]
            text = text[:start] + " " + text[end:]
    makers = [m for m in _CODE.finditer(text) if m[1] not in NOT_MAKERS and m[1] not in known.places and m[1] not in known.measures and not _measured(text, m.end(), known)]
    maker = code = None
    if makers:
        best = min(makers, key=lambda m: (m[1] in known.common, m[2] == " ", m.start()))
        maker, code = best[1], str(int(best[3]))
        text = text[: best.start()] + " " + text[best.end() :]
    size = sorted(_NUMBER.findall(re.sub(r"(?<=\d),(?=\d{3}\b)", "", text)))
    return maker, code, place, size, sorted(set(_WORD.findall(text)))


def _measured(text: str, end: int, known: Lexicon) -> bool:
    """Is the number that ends here followed by a measure?"""
    m = re.match(r"\s*([^\W\d_]{2,})\b(?!-)", text[end:])
    return bool(m) and m[1] in known.measures


def common_amount(quantity: float | None, unit: str | None, notes: str | None, description: str | None) -> tuple[str | None, float | None, float | None]:
    """Dimension (a common unit, null where none is told or it can't be converted), amount in it, half of its last recorded digit."""
    if quantity is None or quantity != quantity:
        quantity = None
    name = re.sub(r"[.\s]+$", "", re.sub(r"\s+", " ", unit.strip().lower())) if unit and unit.strip() else finder("material").told(notes) or finder("material").told(description)
    dimension, factor = _ALIASES.get(name, (None, 1.0)) if name else (None, 1.0)
    if quantity is None:
        return dimension, None, None
    digits = max(1, len(repr(float(quantity)).partition(".")[2])) if "e" not in repr(float(quantity)) else 1
    return dimension, quantity * factor, 0.0 if factor == 1.0 else 0.5 * 10.0**-digits * factor


def described(df: DataFrame, key: str, unit: str, known: Lexicon = Lexicon()) -> DataFrame:
    """id and parts (p) of every row with a description."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf(_PARTS)
    def parts_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*take_apart(d, shared.value), *common_amount(q, u, n, d)) for d, q, u, n in zip(*batch)]
            yield pd.DataFrame(rows, columns=[f.name for f in _PARTS.fields])

    rows = need(df, key, "description", "quantity", unit, "notes").where(F.col(key).isNotNull() & (F.trim("description") != ""))
    rows = rows.select(F.col(key).cast("bigint").alias("id"), parts_of("description", F.col("quantity").cast("double"), F.col(unit), "notes").alias("p"))
    return rows.distinct()  # a repeated row counts once


def classes(each: DataFrame, name: str) -> DataFrame:
    """Classes of rows with equal parts: name (the smallest id), copies (ids), p."""
    return each.groupBy("p").agg(F.min("id").alias(name), F.count(F.lit(1)).alias("copies"))


def _keys() -> Column:
    """Blocking keys: any two of maker with size, code, place (with size where the code is not in it)."""
    size = F.concat_ws(" ", "size")

    def key(kind: str, *parts: Column) -> Column:
        whole = parts[0].isNotNull()
        for p in parts[1:]:
            whole = whole & p.isNotNull()
        return F.when(whole, F.xxhash64(F.lit(kind), *parts))

    maker, code, place = F.col("maker"), F.col("code"), F.col("place")
    return F.filter(F.array(key("cp", code, place), key("mcs", maker, code, size), key("mps", maker, place, size)), lambda k: k.isNotNull())


def _log_odds() -> Column:
    a = lambda c: F.col(f"a.{c}")
    b = lambda c: F.col(f"b.{c}")
    both = lambda c: a(c).isNotNull() & b(c).isNotNull()
    far = F.levenshtein(a("maker"), b("maker")) / F.greatest(F.length(a("maker")), F.length(b("maker")))
    inside = (F.size(F.array_except(a("size"), b("size"))) == 0) | (F.size(F.array_except(b("size"), a("size"))) == 0)
    apart = F.abs(a("amount") - b("amount"))
    same = apart <= QUANTITY_NEAR * F.greatest(F.abs(a("amount")), F.abs(b("amount"))) + F.coalesce(a("slack"), F.lit(0.0)) + F.coalesce(b("slack"), F.lit(0.0)) + 1e-9
    fewer = F.least(F.size(a("words")), F.size(b("words")))
    zero = F.lit(0.0)
    parts = [
        F.when(both("code"), F.when(a("code") == b("code"), CODE[0]).otherwise(CODE[1])).otherwise(zero),
        F.when(both("maker"), F.when(a("maker") == b("maker"), MAKER[0]).when(far <= MAKER_NEAR, MAKER[1]).otherwise(MAKER[2])).otherwise(zero),
        F.when(both("place"), F.when(a("place") == b("place"), PLACE[0]).otherwise(PLACE[1])).otherwise(zero),
        F.when((F.size(a("size")) > 0) & (F.size(b("size")) > 0), F.when(a("size") == b("size"), SIZE[0]).when(inside, SIZE[1]).otherwise(SIZE[2])).otherwise(zero),
        F.when(both("dimension") & (a("dimension") != b("dimension")), DIMENSION_DIFFERS)
        .when(both("dimension") & both("amount"), F.when(same, QUANTITY[0]).otherwise(QUANTITY[1]))
        .otherwise(zero),
        F.when(fewer > 0, WORDS * F.size(F.array_intersect(a("words"), b("words"))) / fewer).otherwise(zero),
    ]
    total = F.lit(PRIOR)
    for p in parts:
        total = total + p
    return total


def candidates(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """item_id, row_id, items, rows (copies of either), odds (log) of the classes that meet under a blocking key."""
    a, b = lines.withColumn("keys", _keys()), rows.withColumn("keys", _keys())
    met = a.select("item_id", F.explode("keys").alias("key")).join(b.select("row_id", F.explode("keys").alias("key")), "key").select("item_id", "row_id").distinct()
    pairs = met.join(a.drop("keys").alias("a"), "item_id").join(b.drop("keys").alias("b"), "row_id")
    return pairs.select("item_id", "row_id", F.col("a.copies").alias("items"), F.col("b.copies").alias("rows"), _log_odds().alias("odds")).where(F.col("odds") > PRIOR)


def _message(pairs: DataFrame, factor: str, copies: str, into: str, out: str) -> DataFrame:
    """Messages of the at-most-one factors of `factor`: out = -log(1 + sum over its other pairs, copies of the other side
    counted, of exp(odds + into)), damped."""
    weight = F.exp(F.col("odds") + F.col(into))
    sums = pairs.groupBy(factor).agg(F.sum(weight * F.col(copies)).alias("all"))
    others = F.greatest(F.col("all") - weight, F.lit(0.0))
    return pairs.join(sums, factor).withColumn(out, DAMPING * F.col(out) - (1 - DAMPING) * F.log1p(others)).drop("all")


def _start(pairs: DataFrame) -> DataFrame:
    """Pairs (with all_row and all_item, the weights of all pairs of the row and of the item) and messages to start from: those
    that stand still if every rival's messages equal the pair's own. Exact for a pair of classes without other rivals
    than their copies, and for rivals that all have one weight; there messages that start from nothing creep."""
    weight = F.exp(F.col("odds"))
    by_row, by_item = (F.greatest(F.col(c) / weight - 1, F.lit(0.0)) for c in ("all_row", "all_item"))
    # u = exp(from_row) = 1 / (1 + by_row weight v) and v = exp(from_item) = 1 / (1 + by_item weight u), so with p = weight u v
    # u = 1 - by_row p, v = 1 - by_item p; the smaller of the two comes from the larger, since 1 - x loses digits near 0
    b = weight * (by_row + by_item) + 1
    p = 2 * weight / (b + F.sqrt(F.pow(weight * (by_row - by_item), 2) + 2 * weight * (by_row + by_item) + 1))
    larger = 1 - F.least(by_row, by_item) * p
    smaller = 1 / (1 + F.greatest(by_row, by_item) * weight * larger)
    u, v = (F.when(c, smaller).otherwise(larger) for c in (by_row >= by_item, by_row < by_item))
    return pairs.withColumns({"from_row": F.log(u), "from_item": F.log(v)}).drop("all_row", "all_item")


def marginals(pairs: DataFrame) -> DataFrame:
    """item_id, row_id, items, rows, confidence of candidate pairs (item_id, row_id, items, rows, odds) under the one-to-one
    factors; of classes with copies, that of any one pair of copies.

    There is no limit of rounds: messages of such factors are known to settle in related models, damping keeps them from
    swinging, and they settled in every case tried; that they always do is not proven here. What must stand still is the
    log-odds of every pair, its two messages together: where lines and rows are equally many, messages may go on to
    shift from one side to the other without any effect. Each round's state replaces the last one's in the checkpoint folder.
    """
    spark = pairs.sparkSession
    pairs = pairs.withColumn("odds", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "odds")))
    weight = F.exp(F.col("odds"))
    by_item = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("of_item"), F.sum(weight * F.col("rows")).alias("all_item"))
    by_row = pairs.groupBy("row_id").agg(F.count(F.lit(1)).alias("of_row"), F.sum(weight * F.col("items")).alias("all_row"))
    counted = cut(_start(pairs.join(by_item, "item_id").join(by_row, "row_id")))
    free = (F.col("of_item") == 1) & (F.col("of_row") == 1)
    sure = 1 / (1 + F.exp(-(F.col("odds") + F.col("from_row") + F.col("from_item"))))
    settled = counted.where(free).select("item_id", "row_id", "items", "rows", "odds", sure.alias("confidence"))
    state = counted.where(~free).select("item_id", "row_id", "items", "rows", "odds", "from_row", "from_item")
    change, last = math.inf, None
    while change >= STILL:
        moved = _message(state.withColumn("was", F.col("from_row") + F.col("from_item")), "row_id", "items", "from_item", "from_row")
        moved = cut(_message(moved, "item_id", "rows", "from_row", "from_item"))
        change = moved.agg(F.max(F.abs(F.col("from_row") + F.col("from_item") - F.col("was")))).first()[0] or 0.0
        state = moved.drop("was")
        if last is not None:
            forget(spark, last)
        last = moved
    return settled.unionByName(state.select("item_id", "row_id", "items", "rows", "odds", sure.alias("confidence")))


def _mutual(found: DataFrame) -> DataFrame:
    """item_id, row_id, confidence, taken (copies of either that match) of the classes that are each other's best."""
    # being repeated makes no pair likelier: all copies count as much as the pair would without any rival, at most
    share = lambda copies: F.least(F.col("confidence") * F.col(copies), 1 / (1 + F.exp(-F.col("odds"))))
    best = lambda key, other, copies: found.groupBy(key).agg(F.max(F.struct("confidence", (-F.col(other)).alias("minus"))).alias("top"), F.sum(share(copies)).alias("mass"))
    items = best("item_id", "row_id", "rows").select("item_id", (-F.col("top.minus")).alias("row_id"), F.col("mass").alias("item_mass"))
    quoted = best("row_id", "item_id", "items").select("row_id", (-F.col("top.minus")).alias("item_id"), F.col("mass").alias("row_mass"))
    mutual = items.join(quoted, ["item_id", "row_id"]).where("greatest(item_mass, row_mass) >= 0.5")
    return mutual.join(found, ["item_id", "row_id"]).select("item_id", "row_id", "confidence", F.least("items", "rows").alias("taken"))


def _members(each: DataFrame, of: DataFrame, name: str, spent: str, known: DataFrame) -> DataFrame:
    """item_id, row_id, nth, id: the taken copies of every pair of classes (known), in the order of their ids after the spent ones."""
    ids = each.join(of.join(known.select(name).distinct(), name).select(name, "p"), "p").select(name, "id")
    ranked = ids.withColumn("nth", F.row_number().over(Window.partitionBy(name).orderBy("id")))
    nth = F.col("nth") - F.col(spent)
    return ranked.join(known, name).where((nth > 0) & (nth <= F.col("taken"))).select("item_id", "row_id", nth.alias("nth"), "id")


def match(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """item_id, row_id, confidence of the matched pairs: each line and each row at most once.

    lines: item_id, description, quantity, unit, notes; rows: row_id, description, quantity, unit_of_measure,
    notes. A pair is matched if it is the best of both its line and its row and one of them is matched, by
    whichever of its pairs, with a probability of at least a half, to which equal copies together add no more than one
    of them would alone. Of equal lines and equal rows as many match as
    there are of both, the smallest ids first and in order; confidence is that of any one pair of the copies, so
    among more copies it is smaller. What is left over, copies or not, is matched by the same rule among itself, as far
    as pairs are more likely than not by themselves, until nothing more matches. Null or blank descriptions match
    nothing; null quantities and unknown units neither support nor contradict a match. Ids must be unique; repeated
    rows of one id count as one.
    """
    known = learn(need(lines, "description"), need(rows, "description"))
    each_item, each_row = cut(described(lines, "item_id", "unit", known)), cut(described(rows, "row_id", "unit_of_measure", known))
    a, b = cut(classes(each_item, "item_id")), cut(classes(each_row, "row_id"))
    open_pairs = candidates(a.select("item_id", "copies", "p.*"), b.select("row_id", "copies", "p.*")).withColumns({"item_spent": F.lit(0), "row_spent": F.lit(0)})
    done = None
    while True:
        open_pairs = cut(open_pairs)
        taken = cut(_mutual(marginals(open_pairs)).join(open_pairs.drop("odds"), ["item_id", "row_id"]))
        done = taken if done is None else done.unionByName(taken)
        of_item, of_row = (taken.select(k, F.col("taken").alias(t)) for k, t in (("item_id", "item_taken"), ("row_id", "row_taken")))
        left = open_pairs.where("odds > 0").join(of_item, "item_id", "left").join(of_row, "row_id", "left").na.fill(0, ["item_taken", "row_taken"])
        left = left.where("items > item_taken and rows > row_taken")
        if taken.isEmpty() or left.isEmpty():
            break
        open_pairs = left.select("item_id", "row_id", F.expr("items - item_taken").alias("items"), F.expr("rows - row_taken").alias("rows"), "odds", F.expr("item_spent + item_taken").alias("item_spent"), F.expr("row_spent + row_taken").alias("row_spent"))
    single = (F.col("taken") == 1) & (F.col("item_spent") == 0) & (F.col("row_spent") == 0)
    several = cut(done.where(~single).select("item_id", "row_id", "confidence", "taken", "item_spent", "row_spent"))
    out = done.where(single).select("item_id", "row_id", "confidence")
    if not several.isEmpty():
        x, y = _members(each_item, a, "item_id", "item_spent", several), _members(each_row, b, "row_id", "row_spent", several)
        copies = x.withColumnRenamed("id", "item").join(y.withColumnRenamed("id", "row"), ["item_id", "row_id", "nth"]).join(several, ["item_id", "row_id"])
        out = out.unionByName(cut(copies.select(F.col("item").alias("item_id"), F.col("row").alias("row_id"), "confidence")))
    for df in (each_item, each_row, a, b, several):
        forget(lines.sparkSession, df)
    return out
