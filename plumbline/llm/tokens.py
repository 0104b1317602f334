"""Encoding of whole texts by a public byte-level tokenizer.

Forced boundaries: a pair of bytes that occurs inside no token of the vocabulary can't be joined by any merge.
Where such a pair also ends one word of the tokenizer's own splitting and begins the next whatever surrounds it,
the text is cut; the fragments are encoded independently and their ids are put together again. Fragments repeat
a great deal, so each worker keeps the ids of those it has met.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import need

#: Fragments whose ids a worker keeps; when there are more it starts anew.
KEPT_FRAGMENTS = 400_000
#: Longer fragments are encoded but not kept.
KEPT_LENGTH = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def inner_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256 table: does this pair of bytes stand inside some token?"""
    inside = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        for pair in zip(token, token[1:]):
            inside[pair] = True
    return inside


#: Classes of ASCII bytes between which the splitting pattern always ends a word: letters, digits, white space.
_CLASSES = {"letter": "A-Za-z", "digit": "0-9"}


def certain_cuts(inside: np.ndarray) -> re.Pattern[str]:
    """Pattern of the places to cut: forced by the vocabulary and ends of words in any context.

    White space belongs to what follows it, so the place between any other character and a blank or line end is an
    end of a word, as is the one between an ASCII letter and a digit, either way. Only those pairs are taken whose
    bytes occur inside no token; for characters beyond ASCII the last byte counts.
    """
    blanks = [b for b in b" \n" if not any(inside[a, b] for a in range(256) if a not in b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")]
    parts = [rf"(?<=[^\s])(?=[{re.escape(''.join(map(chr, blanks)))}])"] if blanks else []
    for one, other in (("letter", "digit"), ("digit", "letter")):
        first, second = (re.findall(f"[{_CLASSES[c]}]", "".join(map(chr, range(128)))) for c in (one, other))
        sure = [a for a in first if not any(inside[ord(a), ord(b)] for b in second)]
        if sure:
            parts.append(rf"(?<=[{''.join(sure)}])(?=[{_CLASSES[other]}])")
    return re.compile("|".join(parts) if parts else r"(?!)")


class Encoder:
    """Ids of texts by the vocabulary file at `path`."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = certain_cuts(inner_pairs(ranks))
        self.kept: dict[str, list[int]] = {}

    def fragments(self, text: str) -> list[str]:
        """The pieces of a text between its forced boundaries; together they are the text."""
        return self.cut.split(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; an empty list for empty and null texts."""
        ids: list[int] = []
        if not text:
            return ids
        kept = self.kept
        for fragment in self.fragments(text):
            known = kept.get(fragment)
            if known is None:
                known = self.encoding.encode_ordinary(fragment)
                if len(fragment) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_FRAGMENTS:
                        kept.clear()
                    kept[fragment] = known
            ids += known
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, ids of every row: array<int>, empty for empty and null texts. Rows are independent; none is dropped.

    `path` names the vocabulary file and must be readable on every executor; it defaults to byte_bpe_50k of the
    installed public tokenizers.
    """
    place = path or vocabulary_path()
    rows = need(df, key, text).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = encoder(place)
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "ids": [use.encode(t) for t in part["text"]]})

    return rows.mapInPandas(batches, f"key {dict(rows.dtypes)['key']}, ids array<int>").withColumnRenamed("key", key)
