"""Evaluation texts leaking into training text, found by latent semantic retrieval and checked word by word.

The corpus is cut into overlapping passages of words that occur in the held-out items. A distributed randomised
SVD of their TF-IDF matrix gives a latent space; passages whose latent vector is close enough to that of a part
of an item are candidates, and each candidate is checked on its words: for a run of consecutive words (verbatim
leak) or a long common subsequence that also has the item's answer: its numbers and most of its seldom words
(paraphrase). The vocabulary is that of the
items, a small fixed set; everything that grows with the corpus stays distributed.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import need

#: Words in a row that make a leak; a passage has twice as many and starts every RUN words, so each run lies in one.
RUN = 12
#: Latent dimensions kept, and extra ones of the sketch.
RANK, EXTRA = 48, 16
#: Least cosine between a passage and a part of an item. Parts start every PART_STEP words.
COSINE, PART_STEP = 0.4, 3
#: A paraphrase has a cosine and a share of the item part's words, in order, of at least these.
PARAPHRASE_COSINE, PARAPHRASE_SHARE = 0.6, 0.7
#: At most so many words of a part are its seldom ones, those that occur at most half as often as its usual words; this share of
#: them must be there beside its numbers.
SELDOM, SELDOM_SHARE = 4, 0.5
#: Most words of all items together: they are held by the driver and each worker.
ITEM_WORDS = 2_000_000
#: Partial sums added up in one task.
FAN_IN = 32
SEED = 17

_HYPHEN = re.compile(r"(?<=\w)[-‐‑][ \t]*(?:\r\n|[\n\r\u0085\u2028\u2029\x0b\x0c])\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
#: Soft hyphen, joiners, zero-width and direction marks, variation selectors, byte order mark.
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits, without invisible characters, words split at a line end joined."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "-" in text or "‐" in text or "‑" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """The held-out items as word ids."""

    ids: list[int]
    texts: list[np.ndarray]
    vocabulary: dict[str, int]
    numeric: np.ndarray  # is this word a number?

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Items:
        vocabulary: dict[str, int] = {}
        ids, texts = [], []
        for key, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
            ids.append(key)
            texts.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(text)], dtype=np.int64))
        if sum(map(len, texts)) > ITEM_WORDS:
            raise ValueError(f"the items have more than {ITEM_WORDS} words; call once for each part of them")
        return cls(ids, texts, vocabulary, np.array([w.isdigit() for w in vocabulary], dtype=bool))

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """(item number, word ids) of the parts of RUN words of all items that have so many."""
        owner, rows = [], []
        for k, text in enumerate(self.texts):
            last = len(text) - RUN
            for at in sorted({*range(0, last + 1, PART_STEP), last} if last >= 0 else ()):
                owner.append(k)
                rows.append(text[at : at + RUN])
        return np.array(owner, dtype=np.int64), np.array(rows, dtype=np.int64).reshape(-1, RUN)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, item number) of every run of RUN words, in order of the hash."""
        hashes = [run_hashes(t[None, :])[0] for t in self.texts]
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
        order = np.lexsort((owner, flat))
        return flat[order], owner[order]


def run_hashes(passages: np.ndarray) -> np.ndarray:
    """Hashes of all runs of RUN ids of each row."""
    n = passages.shape[1] - RUN + 1
    if n <= 0:
        return np.empty((len(passages), 0), dtype=np.int64)
    total = np.zeros((len(passages), n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(RUN):
            total = (total ^ (passages[:, i : i + n].astype(np.uint64) + np.uint64(2))) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(31)
    return total.view(np.int64)


def passages_of(ids: np.ndarray, least: int = RUN) -> np.ndarray:
    """Passages of 2 * RUN ids (-2 past the end) of a text, those with fewer than `least` known words left out."""
    if len(ids) < least:
        return np.empty((0, 2 * RUN), dtype=np.int64)
    blocks = -(-len(ids) // RUN)
    padded = np.full((blocks + 1) * RUN, -2, dtype=np.int64)
    padded[: len(ids)] = ids
    grid = padded.reshape(-1, RUN)
    both = np.concatenate([grid[:-1], grid[1:]], axis=1)
    return both[(both >= 0).sum(1) >= least]


def _weights(passages: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF of passages as (row, word, weight), rows of unit length."""
    rows = np.repeat(np.arange(len(passages)), passages.shape[1])
    flat = passages.ravel()
    known = flat >= 0
    pair, count = np.unique(rows[known] * len(idf) + flat[known], return_counts=True)
    row, word = pair // len(idf), pair % len(idf)
    value = count * idf[word]
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(passages)))
    return row, word, value / np.maximum(norm[row], 1e-12)


def _times(weights: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, right: np.ndarray) -> np.ndarray:
    """Rows of the TF-IDF matrix times a dense matrix."""
    row, word, value = weights
    out = np.zeros((n, right.shape[1]), dtype=np.float32)
    if len(row):
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[starts]] = np.add.reduceat(right[word] * value[:, None].astype(np.float32), starts, axis=0)
    return out


def _times_left(weights: tuple[np.ndarray, np.ndarray, np.ndarray], size: int, dense: np.ndarray) -> np.ndarray:
    """Transposed TF-IDF matrix times a dense one."""
    row, word, value = weights
    order = np.argsort(word, kind="stable")
    row, word, value = row[order], word[order], value[order]
    out = np.zeros((size, dense.shape[1]), dtype=np.float64)
    if len(word):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[starts]] = np.add.reduceat(dense[row] * value[:, None], starts, axis=0)
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.empty((0, 2 * RUN), dtype=np.int64)


def _summed(passages: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sum over all passages of a matrix of fixed shape: one partial sum a task, FAN_IN of them summed in one task, level by
    level, until the driver adds the last FAN_IN."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(shape, dtype=np.float64), False
        for batch in batches:
            for at in range(0, len(batch), 2000):
                seen = True
                add(total, _matrix(batch["passage"].iloc[at : at + 2000]))
        if seen:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "total": [total.tobytes()]})

    def together(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(shape, dtype=np.float64)
        for blob in parts["total"]:
            total += np.frombuffer(blob, dtype=np.float64).reshape(shape)
        return pd.DataFrame({"part": [int(parts["part"].iloc[0]) // FAN_IN], "total": [total.tobytes()]})

    sums, left = passages.select("passage").mapInPandas(partial, "part int, total binary"), passages.rdd.getNumPartitions()
    while left > FAN_IN:
        sums, left = sums.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(together, "part int, total binary"), -(-left // FAN_IN)
    return sum((np.frombuffer(r.total, dtype=np.float64).reshape(shape) for r in sums.collect()), np.zeros(shape))  # at most FAN_IN rows


@dataclass
class Space:
    """Weights of words and the latent directions."""

    idf: np.ndarray
    basis: np.ndarray
    seen: np.ndarray | None = None  # does this word occur in the corpus at all? (None: every word does)


def latent_space(passages: DataFrame, items: Items) -> Space:
    """Randomised SVD of the TF-IDF matrix of all passages over the items' vocabulary: sketch, then rotate."""
    size = len(items.vocabulary)
    part_rows = items.parts()[1]

    def frequencies(total: np.ndarray, block: np.ndarray) -> None:
        row, word, _ = _weights(block, np.ones(size))
        total[:size] += np.bincount(word, minlength=size)
        total[size] += len(block)

    counts = _summed(passages, (size + 1,), frequencies)
    idf = np.log((1 + counts[size]) / (1 + counts[:size])) + 1
    width = min(RANK + EXTRA, size)
    omega = np.random.default_rng(SEED).standard_normal((size, width)).astype(np.float32)

    def sketch(total: np.ndarray, block: np.ndarray) -> None:
        weights = _weights(block, idf)
        total += _times_left(weights, size, _times(weights, len(block), omega))

    # the items' own parts belong to the matrix, so that their directions are in the space
    weights = _weights(part_rows, idf)
    own = _times_left(weights, size, _times(weights, len(part_rows), omega)) if len(part_rows) else 0
    q = np.linalg.qr(_summed(passages, (size, width), sketch) + own)[0].astype(np.float32)

    def gram(total: np.ndarray, block: np.ndarray) -> None:
        b = _times(_weights(block, idf), len(block), q)
        total += b.T @ b

    b = _times(weights, len(part_rows), q) if len(part_rows) else np.zeros((0, width))
    values, vectors = np.linalg.eigh(_summed(passages, (width, width), gram) + b.T @ b)
    return Space(idf, np.ascontiguousarray((q @ vectors[:, ::-1][:, :RANK]).astype(np.float32)), counts[:size] > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    last = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        now = np.maximum(last[1:], np.where(b == x, last[:-1] + 1, 0))
        last = np.concatenate(([0], np.maximum.accumulate(now)))
    return int(last[-1])


def answer_words(rows: np.ndarray, space: Space) -> np.ndarray:
    """Which words of each part are its seldom ones, at most SELDOM; words that the corpus doesn't have tell nothing."""
    asked = np.zeros(rows.shape, dtype=bool)
    if len(rows):
        weight = space.idf[rows] if space.seen is None else np.where(space.seen[rows], space.idf[rows], 0.0)
        np.put_along_axis(asked, np.argsort(-weight, axis=1, kind="stable")[:, :SELDOM], True, axis=1)
        asked &= weight >= np.median(weight, axis=1, keepdims=True) + math.log(2)
    return asked


def has_answer(present: np.ndarray, numeric: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Are all numbers of a part there and enough of its seldom words?"""
    return (present | ~numeric).all(1) & ((present & asked).sum(1) >= SELDOM_SHARE * asked.sum(1))


class Searcher:
    """Candidates by cosine and their checks, for blocks of passages."""

    def __init__(self, items: Items, space: Space, paraphrases: bool) -> None:
        self.items, self.space, self.paraphrases = items, space, paraphrases
        self.owner, self.rows = items.parts()
        self.latent = _unit(_times(_weights(self.rows, space.idf), len(self.rows), space.basis))
        self.starts = np.flatnonzero(np.concatenate(([True], self.owner[1:] != self.owner[:-1]))) if len(self.owner) else np.empty(0, np.int64)
        self.hashes, self.hash_owner = items.runs()
        self.asked = answer_words(self.rows, space)

    def search(self, docs: np.ndarray, passages: np.ndarray) -> Iterator[tuple[int, int, str, float]]:
        """(item id, doc id, kind, cosine) of the leaks in a block."""
        if not len(passages) or not len(self.rows):
            return
        latent = _unit(_times(_weights(passages, self.space.idf), len(passages), self.space.basis))
        cosine = latent @ self.latent.T
        by_item = np.maximum.reduceat(cosine, self.starts, axis=1)
        item_of = self.owner[self.starts]
        column = np.full(len(self.items.ids), -1)
        column[item_of] = np.arange(len(item_of))
        close = np.flatnonzero((by_item >= COSINE).any(1))  # passages with a candidate; their words are checked
        hashes = run_hashes(passages[close])
        first, last = np.searchsorted(self.hashes, hashes.ravel(), "left"), np.searchsorted(self.hashes, hashes.ravel(), "right")
        verbatim = set()
        for k in np.flatnonzero(last > first):
            row, at = close[k // hashes.shape[1]], k % hashes.shape[1]
            for item in self.hash_owner[first[k] : last[k]]:
                if (row, item) not in verbatim and by_item[row, column[item]] >= COSINE and self._stands(passages[row, at:][:RUN], item):
                    verbatim.add((row, item))
                    yield self.items.ids[item], int(docs[row]), "verbatim", float(by_item[row, column[item]])
        if not self.paraphrases:
            return
        best: dict[tuple[int, int], float] = {}
        pairs = np.argwhere(cosine >= PARAPHRASE_COSINE)
        for at in range(0, len(pairs), 20_000):
            near, part = pairs[at : at + 20_000].T
            present = (self.rows[part][:, :, None] == passages[near][:, None, :]).any(2)
            likely = (present.sum(1) >= PARAPHRASE_SHARE * RUN) & has_answer(present, self.items.numeric[self.rows[part]], self.asked[part])
            for row, k in zip(near[likely].tolist(), part[likely].tolist()):
                pair = (row, int(self.owner[k]))
                if pair not in verbatim and cosine[row, k] > best.get(pair, -1.0) and common_subsequence(self.rows[k], passages[row]) >= PARAPHRASE_SHARE * RUN:
                    best[pair] = float(cosine[row, k])
        for (row, item), value in best.items():
            yield self.items.ids[item], int(docs[row]), "paraphrase", value

    def _stands(self, run: np.ndarray, item: int) -> bool:
        text = self.items.texts[item]
        return any(np.array_equal(text[i : i + RUN], run) for i in np.flatnonzero(text[: len(text) - RUN + 1] == run[0]))


def passages(corpus: DataFrame, key: str, text: str, items: Items, least: int = RUN) -> DataFrame:
    """doc_id, passage (2 * RUN word ids, -1 for a word of no item) of every text."""
    vocabulary = corpus.sparkSession.sparkContext.broadcast(items.vocabulary)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        for batch in batches:
            docs, rows = [], []
            for doc, body in zip(batch["doc_id"], batch["text"]):
                found = passages_of(np.array([known.get(w, -1) for w in words(body)], dtype=np.int64), least)
                docs += [doc] * len(found)
                rows.append(found)
                if len(docs) > 20_000:
                    yield pd.DataFrame({"doc_id": docs, "passage": list(np.concatenate(rows).astype(np.int32))})
                    docs, rows = [], []
            if docs:
                yield pd.DataFrame({"doc_id": docs, "passage": list(np.concatenate(rows).astype(np.int32))})

    rows = need(corpus, key, text).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInPandas(cut_up, "doc_id bigint, passage array<int>")


def leaks(corpus: DataFrame, key: str, text: str, heldout: DataFrame, item_key: str, item_text: str, paraphrases: bool = True) -> DataFrame:
    """item_id, doc_id, kind (verbatim or paraphrase), cosine: the documents in which an item leaked, once per kind.

    verbatim: the document has RUN consecutive words of the item. Items of fewer words can't leak; null and empty
    texts hold and leak nothing; items of equal texts each get their rows; repeated documents each get theirs.
    """
    spark = corpus.sparkSession
    items = Items.of([(r[0], r[1]) for r in need(heldout, item_key, item_text).collect()])  # a fixed set, at most ITEM_WORDS words
    schema = "item_id bigint, doc_id bigint, kind string, cosine double"
    if not any(len(t) >= RUN for t in items.texts):
        return spark.createDataFrame([], schema)
    cut_up = cut(passages(corpus, key, text, items, math.ceil(PARAPHRASE_SHARE * RUN) if paraphrases else RUN))
    searcher = spark.sparkContext.broadcast((items, latent_space(cut_up, items)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = Searcher(*searcher.value, paraphrases)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                rows += use.search(part["doc_id"].to_numpy(), _matrix(part["passage"]))
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "kind", "cosine"])

    found = cut_up.mapInPandas(search, schema)
    return found.groupBy("item_id", "doc_id", "kind").agg(F.max("cosine").alias("cosine"))
