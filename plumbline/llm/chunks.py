"""Splitting of long texts at natural boundaries, with an overlap between consecutive pieces.

Landmarks are the places whose rolling hash is the least within REACH characters on either side: which places they
are is told by the text around them alone. Gaps too wide for a piece are divided again at the least hash inside
them. Each cut snaps from its landmark to the nearest natural boundary (page marker, then line end, sentence end,
other white space), so an edit moves only the cuts of the landmarks beside it and pieces further away stay as they
are. A stretch without white space that doesn't fit a piece is cut by force.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import need

#: Most characters in a piece, most characters of overlap with the piece before.
LIMIT, OVERLAP = 8000, 400
#: A landmark has the least hash within so many characters on either side; the hash looks at so many before a place.
REACH, HASH_SPAN = 2000, 32
#: A boundary of a better kind is preferred this near a landmark.
SNAP = 512

_PAGE = re.compile(r"\n(?=--- PAGE \d+ ---)")
_LINE = re.compile(r"[\n\r]+(?=[^\n\r])")
_SENTENCE = re.compile(r"[.!?…。][\"'”’)\]]*\s+(?=\S)")
_SPACE = re.compile(r"\s+")


def _hashes(text: str) -> np.ndarray:
    """Hash of the HASH_SPAN characters before each place from HASH_SPAN on, in one vectorised pass."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < HASH_SPAN:
        return np.empty(0, dtype=np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    base = np.uint64(0xBF58476D1CE4E5B9)
    rolling, width, power = codes, 1, base
    with np.errstate(over="ignore"):
        while width < HASH_SPAN:  # the hash of 2n characters from two of n
            rolling = rolling[:-width] * power + rolling[width:]
            power = power * power
            width *= 2
    return rolling >> np.uint64(16)


def _least_around(values: np.ndarray, reach: int) -> np.ndarray:
    """Least of each value and the `reach` values before it and after it: minima from the edges of blocks inwards."""
    width = 2 * reach + 1
    highest = np.iinfo(values.dtype).max
    padded = np.full(-(-(len(values) + 2 * reach) // width) * width, highest, dtype=values.dtype)
    padded[reach : reach + len(values)] = values
    blocks = padded.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(values)], forth[width - 1 : width - 1 + len(values)])


def _landmarks(text: str, reach: int, widest: int) -> np.ndarray:
    """Places of the landmarks in order, gaps wider than `widest` divided where the hash inside them is least.

    Of equal hashes within reach only the first counts.
    """
    hashes = _hashes(text)
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    found, last = [], -reach - 1
    for place in np.flatnonzero(hashes == _least_around(hashes, reach)).tolist():
        if place - last > reach or hashes[place] != hashes[last]:
            found.append(place)
            last = place
    marks, at = [], 0
    for place in [*(f + HASH_SPAN for f in found), len(text)]:
        while place - at > widest:  # between reach from either end there is always a place: widest is more than twice reach
            low, high = at + reach, min(at + widest, place - reach)
            inside = hashes[max(0, low - HASH_SPAN) : max(0, high - HASH_SPAN) + 1]
            at = low + int(np.argmin(inside)) if len(inside) else high
            marks.append(at)
        if place < len(text):
            marks.append(place)
            at = place
    return np.array(marks, dtype=np.int64)


def _boundaries(text: str) -> list[np.ndarray]:
    """Places of page markers, line ends, sentence ends and white space: cuts before the first character after it,
    for white space also before its own first character."""
    kinds = [np.array([m.end() for m in p.finditer(text)], dtype=np.int64) for p in (_PAGE, _LINE, _SENTENCE)]
    return [*kinds, np.unique(np.array([x for m in _SPACE.finditer(text) for x in m.span()], dtype=np.int64))]


def _nearest(places: np.ndarray, low: int, high: int, to: int) -> int | None:
    a, b = np.searchsorted(places, low, "left"), np.searchsorted(places, high, "right")
    if a >= b:
        return None
    inside = places[a:b]
    return int(inside[np.argmin(np.abs(inside - to))])


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, reach: int = REACH) -> list[tuple[int, int, int, bool]]:
    """(start, new_from, end, forced) of the pieces of a text: text[start:end] is a piece, at most `limit` long;
    text[start:new_from] repeats the end of the piece before, at most `overlap`; the parts from new_from on are
    the text without gap or repetition. forced: the cut at `end` falls inside a stretch without white space.
    A null or empty text has no pieces."""
    if not text:
        return []
    size = len(text)
    if size <= limit:
        return [(0, 0, size, False)]
    kinds = _boundaries(text)
    spaces = kinds[-1]
    most = limit - overlap
    snap = min(SNAP, most // 12)
    reach = min(reach, most // 3)
    least = max(1, reach - 2 * snap)
    marks = _landmarks(text, reach, most - 2 * snap)
    pieces, at, start = [], 0, 0
    while True:
        if size - start <= limit:
            pieces.append((start, at, size, False))
            return pieces
        low, high = at + least, start + limit
        forced = False
        k = int(np.searchsorted(marks, low))
        target = min(int(marks[k]) if k < len(marks) else size, at + most)
        end = None
        for places in kinds:  # the best kind of boundary near the landmark, else any in the whole span
            end = _nearest(places, max(low, target - snap), min(high, target + snap), target)
            if end is not None:
                break
        for places in kinds if end is None else []:
            end = _nearest(places, low, high, target)
            if end is not None:
                break
        if end is None:
            end = _nearest(spaces, at + 1, high, high)
        if end is None and start < at:  # a long stretch may still fit a piece that repeats nothing
            start = at
            end = _nearest(spaces, at + 1, min(at + limit, size), at + limit)
            high = min(at + limit, size)
            if end is None and size - at <= limit:
                pieces.append((at, at, size, False))
                return pieces
        if end is None:
            end, forced = high, True
        pieces.append((start, at, end, forced))
        repeat = _nearest(spaces, end - overlap, end - 1, end - overlap)
        at = end
        start = end if forced and repeat is None else (repeat if repeat is not None else end)


_CUTS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("new_from", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("forced", T.BooleanType())]))


@F.pandas_udf(_CUTS)
def cuts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Places of the pieces of each text; the texts themselves don't come back from Python."""
    for texts in batches:
        yield pd.Series([split_text(t) for t in texts], dtype=object)


def pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pieces of each text, in order: key, piece_no (from 0), start, new_from, end, forced, piece.

    Lengths are in characters (code points). Texts within the limit are one piece; null and empty texts have
    none. Rows are independent; repeated keys repeat their pieces.
    """
    rows = need(df, key, text).select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null and text <> ''")
    cut_up = rows.select("key", "text", F.posexplode(cuts_of("text")).alias("piece_no", "c"))
    return cut_up.select("key", "piece_no", "c.*", F.substring("text", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("piece"))


def how_cut(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, cut (natural or forced) of each text longer than the limit."""
    cut = pieces(df.where(F.char_length(text) > LIMIT), key, text).groupBy("key").agg(F.bool_or("forced").alias("any_forced"))
    return cut.select(F.col("key").alias(key), F.when(F.col("any_forced"), "forced").otherwise("natural").alias("cut"))
