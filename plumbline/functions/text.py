"""Text normalisation and extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def norm_description(text: Column) -> Column:
    """As norm, after a leading section number like `03 30 00` is cut off."""
    return norm(F.regexp_replace(text, r"^\s*\d{2}\s\d{2}\s\d{2}\s*[-:.]?\s*", ""))


def header_key(text: Column) -> Column:
    """Upper-case letters only, other runs to single blanks."""
    return F.trim(F.regexp_replace(F.upper(text), "[^A-Z]+", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def head_and_tail(text: Column, limit: int, marker: str = "\n[...]\n") -> Column:
    """The text, or its first and last halves around a marker where it is longer than `limit` characters."""
    half = limit // 2
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half)))).otherwise(text)


def holds_mark(text: Column, mark: Column) -> Column:
    """Does `mark`, of two characters or more, stand as a whole token in `text`, whatever its case?"""
    bounded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]", " "), F.lit(" "))
    exact = F.regexp_replace(F.lower(mark), "[^a-z0-9]", " ")
    return (F.char_length(mark) >= 2) & bounded.contains(F.concat(F.lit(" "), exact, F.lit(" ")))


def notes_map(notes: Column) -> Column:
    """`source=x; mark=y` as a map; parts without `=` are left out, of repeated keys the last counts."""
    pairs = F.filter(F.split(notes, r"\s*;\s*"), lambda p: p.contains("="))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("value")))
    last = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_from_entries(F.array_append(F.filter(F.map_entries(m), lambda x: x["key"] != e["key"]), e)))
    return last


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments dropped, tags to blanks, the five basic entities decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    return collapse(bare)


def html_title(html: Column) -> Column:
    return F.nullif(collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_item(html: Column, name: str) -> Column:
    """Content of <meta itemprop=name content=...> or the text of an element with that itemprop."""
    meta = F.regexp_extract(html, rf"(?is)<meta[^>]*itemprop=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    text = F.regexp_extract(html, rf"(?is)<(\w+)[^>]*itemprop=[\"']{name}[\"'][^>]*>(.*?)</\1>", 2)
    return F.coalesce(F.nullif(F.trim(meta), F.lit("")), F.nullif(html_text(text), F.lit("")))


def code_block_json(text: Column) -> Column:
    """The JSON object or array inside a reply that may wrap it in a fence or prose."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(fenced != "", fenced).otherwise(text)
    return F.nullif(F.regexp_extract(inner, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
