"""Near-duplicate records: all pairs of word sets with a Jaccard similarity of at least a threshold.

Exact and without comparing all pairs. Records with one word set are one class. The words of a class are ordered
by rarity; two similar sets must share at least two of their rarest words (one, for sets of many words), so sets
meet only in cells: one for each seldom word among these, one for each two frequent ones. In a cell, each set is a
point: the bits of its fingerprint (one bit per word) counted by segment. The Manhattan distance of two points is
at most the number of words in which the sets differ, so pairs too far apart for their sizes fall out there. What
remains is verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Least number of distinct words of a set that takes part, and least similarity of a pair.
LEAST_WORDS, SIMILARITY = 8, 0.7
#: Up to this many words, sets meet by two shared words; beyond, by one.
PAIR_CELLS = 64
#: A word of at most so many classes is seldom: its cell is small enough to need no second word.
SELDOM = 64
#: Word frequencies are kept for so many hash buckets: a fixed 4 MB, whatever the vocabulary. They order words and
#: tell the seldom ones; a bucket shared by several words only makes them look more frequent.
FREQUENCY_BUCKETS = 1 << 20
#: Segments of a fingerprint, four bits of a number each; counts beyond 15 count as 15, which keeps the bound.
SEGMENTS = 16
#: A cell of more sets is compared in parts, each of about so many sets against all of the cell.
CELL = 20_000
#: Most tables in one call.
TABLES = 1000


def word_set(text: Column) -> Column:
    """Distinct words (lower-cased runs of a-z and 0-9) in order; empty for null."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))))


def _least(share: float, n: np.ndarray) -> np.ndarray:
    return np.ceil(share * n - 1e-9).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch], frequency: np.ndarray, t: float, parts: np.ndarray | None, large: int = CELL) -> Iterator[pa.RecordBatch]:
    """From tab_no, class_id, hashes (of the distinct words) the cells of each class: key, class_id, points, about.

    about packs the table, the number of words, whether the row also counts where the class is the smaller one, and
    whether it counts where it is the larger one. parts tells by hash bucket of the key in how many parts a cell is
    compared: there, a set is the larger one in one of the parts and the smaller one in all. Without `parts` only the
    keys come out of those cells whose words are frequent enough that they may have to be parted.
    """
    mask = np.int64(FREQUENCY_BUCKETS - 1)
    shifts = np.arange(SEGMENTS, dtype=np.int64) * 4
    for batch in batches:
        lists = batch.column("hashes")
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(n):
            continue
        tab, class_id = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tab_no", "class_id"))
        owner = np.repeat(np.arange(len(n)), n)
        often = frequency[flat & mask]
        order = np.lexsort((flat, often, owner))
        flat, often, start = flat[order], often[order], np.concatenate(([0], np.cumsum(n)[:-1]))
        seldom = often <= SELDOM
        segment = (flat >> np.int64(24)) & np.int64(SEGMENTS - 1)
        counts = np.minimum(np.bincount(owner * SEGMENTS + segment, minlength=len(n) * SEGMENTS).reshape(len(n), SEGMENTS), 15).astype(np.int64)
        points = (counts << shifts).sum(1)
        about = (tab << np.int64(32)) | (np.minimum(n, 0x1FFFFFFF) << np.int64(2))
        keys, sets, roles = [], [], []

        def emit(chosen: np.ndarray, first: np.ndarray, second: np.ndarray | np.int64, is_short: np.ndarray, most: np.ndarray) -> None:
            with np.errstate(over="ignore"):
                key = np.minimum(first, second) * np.int64(-7046029254386353131) + np.maximum(first, second) + tab[chosen] * np.int64(-4417276706812531889)
            if parts is None:
                keys.append(key[most > large])
                return
            share = parts[key & mask]
            whole = share <= 1
            keys.append(key[whole])
            sets.append(chosen[whole])
            roles.append(is_short[whole].astype(np.int64) | np.int64(2))
            if whole.all():
                return
            key, chosen, is_short, share = key[~whole], chosen[~whole], is_short[~whole], share[~whole]
            with np.errstate(over="ignore"):
                own = (class_id[chosen] * np.int64(-7046029254386353131) >> np.int64(33)) % share
                keys.append(key + (own + np.int64(1)) * np.int64(-3335678366873096957))
                sets.append(chosen)
                roles.append(np.full(len(chosen), 2, dtype=np.int64))
                key, chosen, share = key[is_short], chosen[is_short], share[is_short]
                each = np.repeat(np.arange(len(share)), share)
                part = np.arange(len(each)) - np.repeat(np.cumsum(share) - share, share)
                keys.append(key[each] + (part + np.int64(1)) * np.int64(-3335678366873096957))
            sets.append(chosen[each])
            roles.append(np.ones(len(each), dtype=np.int64))

        longest, shortest = n - _least(t, n), n - _least(2 * t / (1 + t), n)
        by_two = np.flatnonzero(_least(t, n) <= PAIR_CELLS)  # a partner of at most PAIR_CELLS words is possible
        if len(by_two):
            long2, short2 = np.minimum(longest + 2, n), np.where(n <= PAIR_CELLS, np.minimum(shortest + 2, n), 0)
            for j in range(int(long2[by_two].max())):
                who = by_two[long2[by_two] > j]
                at = start[who] + j
                few = seldom[at]
                emit(who[few], flat[at[few]], np.int64(2), short2[who[few]] > j, often[at[few]])
                who, at = who[~few], at[~few]
                for i in range(j):
                    other = start[who] + i
                    both = ~seldom[other]
                    emit(who[both], flat[other[both]], flat[at[both]], short2[who[both]] > j, np.minimum(often[other[both]], often[at[both]]))
        by_one = np.flatnonzero((n > PAIR_CELLS) | (t * n <= 1 + 1e-9))  # many words, or so few that one shared word may do
        if len(by_one):
            long1, short1 = np.minimum(longest + 1, n), shortest + 1
            width = long1[by_one]
            who = np.repeat(by_one, width)
            i = np.arange(len(who)) - np.repeat(np.cumsum(width) - width, width)
            emit(who, flat[start[who] + i], np.int64(1), short1[who] > i, often[start[who] + i])
        if keys and parts is None:
            yield from pa.table({"key": pa.array(np.concatenate(keys))}).to_batches()
        elif keys:
            chosen = np.concatenate(sets)
            yield from pa.table({
                "key": pa.array(np.concatenate(keys)), "class_id": pa.array(class_id[chosen]), "points": pa.array(points[chosen]), "about": pa.array(about[chosen] | np.concatenate(roles)),
            }).to_batches()


def _keyed(records: DataFrame, least_words: int) -> DataFrame:
    """tab, id, words, content (a SHA-256 of the words) of the records that take part."""
    sets = records.where("id is not null and text is not null").select("tab", "id", word_set(F.col("text")).alias("words")).where(F.size("words") >= least_words)
    return sets.withColumn("content", F.unhex(F.sha2(F.concat_ws(" ", "words"), 256)))


def classes(records: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per word set of records (tab, id, text): tab, content, class_id (its smallest id), words. Sets of fewer words fall out."""
    return _keyed(records, least_words).groupBy("tab", "content").agg(F.min("id").alias("class_id"), F.first("words").alias("words"))


def members(records: DataFrame, found: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """tab, class_id, id of every record in one of the classes `found`."""
    keyed = _keyed(records, least_words).select("tab", "content", "id")
    return keyed.join(found.select("tab", "content", "class_id"), ["tab", "content"]).select("tab", "class_id", "id").distinct()


def frequencies(found: DataFrame) -> np.ndarray:
    """Occurrences of words over all classes by hash bucket: a table of fixed size."""
    buckets = found.select(F.explode("words").alias("word")).groupBy(F.expr(f"cast(xxhash64(word) & {FREQUENCY_BUCKETS - 1} as int)").alias("bucket")).count()
    rows = buckets.select("bucket", F.least("count", F.lit(2**31 - 1)).cast("int").alias("n")).toPandas()  # at most FREQUENCY_BUCKETS rows
    table = np.zeros(FREQUENCY_BUCKETS, dtype=np.int32)
    table[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return table


def _manhattan(a: str, b: str) -> str:
    return " + ".join(f"abs((({a}.points >>> {s}) & 15) - (({b}.points >>> {s}) & 15))" for s in range(0, SEGMENTS * 4, 4))


def _parts(hashed: DataFrame, frequency: np.ndarray, t: float, cell: int) -> np.ndarray:
    """In how many parts the cells of each hash bucket of keys are compared: a table of fixed size.

    A cell has no more sets than its rarer word occurs, so only cells of two words above `cell` are counted.
    """
    spark = hashed.sparkSession
    if np.count_nonzero(frequency > cell) < 1:
        return np.ones(FREQUENCY_BUCKETS, dtype=np.int64)
    table = spark.sparkContext.broadcast(frequency)
    keys = hashed.mapInArrow(lambda batches: _cells(batches, table.value, t, None, cell), "key bigint")
    counted = keys.groupBy(F.expr(f"cast(key & {FREQUENCY_BUCKETS - 1} as int)").alias("bucket")).count().where(F.col("count") > cell)
    rows = counted.select("bucket", F.ceil(F.col("count") / cell).alias("n")).toPandas()  # at most FREQUENCY_BUCKETS rows
    parts = np.ones(FREQUENCY_BUCKETS, dtype=np.int64)
    parts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return parts


def similar_classes(found: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """Pairs of classes at least so similar: tab, class_a, class_b (a < b), shared, together (words).

    Cells of more than `cell` sets are compared in parts, by as many tasks.
    """
    spark = found.sparkSession
    tabs = sorted(r[0] for r in found.select("tab").distinct().limit(TABLES + 1).collect())
    if len(tabs) > TABLES:
        raise ValueError(f"more than {TABLES} tables")
    tab_no = F.coalesce(*[F.when(F.col("tab") == t, i) for i, t in enumerate(tabs)], F.lit(0)) if tabs else F.lit(0)
    hashed = found.select(tab_no.cast("bigint").alias("tab_no"), "class_id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    frequency = frequencies(found)
    tables = spark.sparkContext.broadcast((frequency, _parts(hashed, frequency, similarity, cell)))
    placed = hashed.mapInArrow(lambda batches: _cells(batches, tables.value[0], similarity, tables.value[1]), "key bigint, class_id bigint, points bigint, about bigint")
    a, b = placed.alias("a"), placed.alias("b")
    n_a, n_b = "((a.about & 4294967295) >> 2)", "((b.about & 4294967295) >> 2)"
    meet = f"""a.key = b.key and (a.about & 2) = 2 and (b.about & 1) = 1 and (a.about >> 32) = (b.about >> 32)
      and ({n_b} < {n_a} or ({n_b} = {n_a} and b.class_id < a.class_id)) and {n_b} >= {n_a} * {similarity!r} - 1e-9
      and {_manhattan("a", "b")} <= {(1 - similarity) / (1 + similarity)!r} * ({n_a} + {n_b}) + 1e-9"""
    pair = ["cast(a.about >> 32 as int) tab_no", "least(a.class_id, b.class_id) class_a", "greatest(a.class_id, b.class_id) class_b"]
    candidates = a.join(b, F.expr(meet)).selectExpr(*pair).distinct()
    named = candidates.withColumn("tab", F.element_at(F.array(*map(F.lit, tabs or [""])), F.col("tab_no") + 1)).drop("tab_no")
    words = found.select("tab", "class_id", "words")
    pairs = named.join(words.select("tab", F.col("class_id").alias("class_a"), F.col("words").alias("words_a")), ["tab", "class_a"])
    pairs = pairs.join(words.select("tab", F.col("class_id").alias("class_b"), F.col("words").alias("words_b")), ["tab", "class_b"])
    shared = F.size(F.array_intersect("words_a", "words_b"))
    verified = pairs.select("tab", "class_a", "class_b", shared.alias("shared"), (F.size("words_a") + F.size("words_b") - shared).alias("together"))
    return verified.where(F.col("shared") >= F.col("together") * similarity - 1e-9)


def near_duplicates(records: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs) of records (tab, id, text).

    membership: tab, class_id, id, one row per record of at least `least_words` distinct words; records of equal
    word sets are one class. pairs: similar classes, as by similar_classes. Null texts, texts of fewer words and
    null ids take no part; a repeated row counts once. Empty inputs give empty results.
    """
    found = cut(classes(records, least_words))
    return members(records, found, least_words), similar_classes(found, similarity)


def record_pairs(records: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """All pairs of similar records, copies expanded: tab, id_a, id_b with id_a < id_b."""
    member, pairs = near_duplicates(records, similarity, least_words)
    member = cut(member)
    a = member.select("tab", F.col("class_id").alias("class_a"), F.col("id").alias("x"))
    b = member.select("tab", F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    across = pairs.join(a, ["tab", "class_a"]).join(b, ["tab", "class_b"]).select("tab", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = a.join(b.withColumnRenamed("class_b", "class_a"), ["tab", "class_a"]).where("x < y").select("tab", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(within)
