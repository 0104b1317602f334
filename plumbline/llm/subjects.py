"""Subject areas of documents by class-association rules.

Sentences are split with the help of how sentences open in the corpus itself. Frequent sets of up to RULE_WORDS words
and their subject codes are mined from labelled documents with parallel FP-growth: each shard of words grows patterns
from the transactions that end in one of its words, and stops at that length. Sets that point to a subject become
rules, those that a shorter rule makes redundant are dropped, and the evidence of a sentence's matching rules is
calibrated against the labels. Wordings in which subjects are mentioned only in passing are learnt from all
documents: there, the subject found disagrees with the rest of the document. A document deals with a subject if
enough of its sentences do.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import need

#: Share of a document's sentences that must deal with a subject.
SHARE = 0.25
#: Rules are fitted on at most so many labelled documents, the first in the order of a hash of their ids.
LABELLED_DOCS = 20_000
#: Documents a word must occur in to take part in rules, and how many times likelier than usual it must make some subject,
#: or by which share of the way from usual to certain.
WORD_DOCS, WORD_LIFT, WORD_GAIN = 3, 2.0, 0.3
#: Least share of sentences and least number of them that hold a rule's words; most words of a rule; least confidence.
SUPPORT, SUPPORT_COUNT, RULE_WORDS, CONFIDENCE = 1e-4, 3, 3, 0.5
#: Gain in confidence that a longer rule needs over a shorter one it contains; sentences of doubt added to every rule; rounds
#: in which sentences of documents with several subjects are given to one of them and rules counted again.
GAIN, DOUBT, ROUNDS = 0.01, 1, 2
#: How much surer a rule may be than a longer one that contains it and points elsewhere, and still be overruled.
OVERRULED = 0.2
#: An opening is two words that start at least this share of lines and sentences; the first may be any seldom word. In
#: text all in capitals it must stand at a start at least this share of the times it occurs.
OPENING, OPENING_COUNT, OPENING_ALONE = 2e-4, 3, 0.5
#: A wording is one of passing mentions if it stands in this share of sentences and so rarely agrees with the rest.
PASSING_SHARE, PASSING_COUNT, PASSING_AGREES, AGREES = 1e-4, 8, 0.1, 0.2
BINS = 10
#: Shards of words among which patterns are grown.
SHARDS = 48
#: Verdicts on word sets that a worker keeps; when there are more it starts anew.
KEPT_SETS = 200_000

_LINE = re.compile(r"[\r\n\x0b\x0c\u0085\u2028\u2029]+")
_END = re.compile(r"[.!?][\"”’')\]]*\s+(?=[\"“‘(\[]*[^\Wa-z_]|[¿¡\-–—•*])")
_INNER = re.compile(r"\s(?=[^\Wa-z_]|[¿¡(\-–•*])(?=(\S+)\s+(\S+))")
_WORD = re.compile(r"[a-z]{3,}")
_HEADER = re.compile(r"(?i)\s*(?:-+\s*page\s+\d+\s*-+|(?:subject|asunto|re|fw|fwd|to|from|cc|date)\s*:.{0,80})$")
_DIGITS = re.compile(r"\d+")
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")


@lru_cache(maxsize=1)
def _combining() -> re.Pattern[str]:
    """All combining marks, by their ranges."""
    marks = [c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    ends = [c for c in marks if not unicodedata.combining(chr(c + 1))]
    starts = [c for c in marks if not unicodedata.combining(chr(c - 1))]
    return re.compile("[" + "".join(f"{chr(x)}-{chr(y)}" for x, y in zip(starts, ends)) + "]")


def plain(text: str) -> str:
    """Lower case without accents and invisible characters."""
    if text.isascii():
        return text.lower()
    return _combining().sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text).lower()))


@lru_cache(maxsize=100_000)
def _opening(first: str, second: str) -> tuple[str, str]:
    return _DIGITS.sub("0", plain(first)), _DIGITS.sub("0", plain(second))


def stretches(text: str) -> Iterator[str]:
    """Lines of a text, cut after the ends of sentences."""
    for line in _LINE.split(text):
        last = 0
        for m in _END.finditer(line):
            part = line[last : m.start() + 1].strip()
            last = m.end()
            if part:
                yield part
        part = line[last:].strip()
        if part:
            yield part


def _is_mark(part: str) -> bool:
    """Page markers, mail headers and stray marks are no sentences: less than two words without an end of a sentence."""
    return bool(_HEADER.match(part)) or (part[-1] not in ".!?;:" and len(_WORD.findall(plain(part))) < 2)


def sentences(text: str | None, openings: dict[tuple[str, str], bool]) -> list[str]:
    """Sentences of a text: its stretches, cut again before an opening that stands inside one, without page marks and headers.

    openings: whether they stand almost only at starts, which is asked for in stretches all in capitals.
    """
    found = []
    for part in stretches(text or ""):
        last, capitals = 0, part.isupper()
        for m in _INNER.finditer(part):
            pair = _opening(*m.groups())
            alone = openings.get(pair)
            if alone is None and not capitals and pair[0][:1].isalpha():
                alone = openings.get(("*", pair[1]))
            if alone is not None and (alone or not capitals) and (before := part[last : m.start()].strip()):
                found.append(before)
                last = m.start() + 1
        found.append(part[last:].strip())
    return [f for f in found if f and not _is_mark(f)]


def words(sentence: str) -> frozenset[str]:
    return frozenset(_WORD.findall(plain(sentence)))


@dataclass
class Rules:
    """What has been learnt: openings, words of rules, rules by their words, calibration."""

    openings: dict[tuple[str, str], bool] = field(default_factory=dict)
    inside: frozenset[str] = frozenset()
    rules: dict[tuple[str, ...], list[tuple[str, float]]] = field(default_factory=dict)
    calibration: list[float] = field(default_factory=lambda: [(i + 0.5) / BINS for i in range(BINS)])
    kept: dict[frozenset[str], str | None] = field(default_factory=dict, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "kept": {}}

    def matching(self, found: frozenset[str]) -> Iterator[tuple[tuple[str, ...], str, float]]:
        """Rules whose words are all found: words, subject, confidence."""
        items = sorted(found & self.inside)
        for size in range(1, RULE_WORDS + 1):
            for chosen in combinations(items, size):
                for subject, confidence in self.rules.get(chosen, ()):
                    yield chosen, subject, confidence

    def evidence(self, found: frozenset[str], among: set[str] | None = None) -> tuple[str, float] | None:
        """Subject (of those in `among`) with the strongest evidence and its score: its best rule, on a tie the sum of all."""
        matched = [m for m in self.matching(found) if among is None or m[1] in among]
        best: dict[str, list[float]] = {}
        for chosen, subject, confidence in matched:
            part = set(chosen)
            # a rule says nothing where a longer one that contains it says something else about as surely
            if not any(len(c) > len(part) and s != subject and x >= confidence - OVERRULED and part < set(c) for c, s, x in matched):
                best.setdefault(subject, []).append(confidence)
        if not best:
            return None
        subject = min(best, key=lambda s: (-round(max(best[s]), 6), -sum(best[s]), s))
        return subject, min(max(best[subject]), 1.0)

    def subject(self, found: frozenset[str]) -> str | None:
        """The subject of a sentence, if its calibrated probability is at least a half."""
        inside = found & self.inside
        if inside in self.kept:
            return self.kept[inside]
        told = self.evidence(inside)
        if len(self.kept) >= KEPT_SETS:
            self.kept.clear()
        verdict = told[0] if told and self.calibration[min(int(told[1] * BINS), BINS - 1)] >= 0.5 else None
        self.kept[inside] = verdict
        return verdict


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    rows = need(documents, key, text).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.where("doc_id is not null and text is not null and trim(text) <> ''")


def common_openings(texts: DataFrame) -> dict[tuple[str, str], bool]:
    """Pairs of words that often open a line or sentence, and whether they seldom stand elsewhere.

    At most 1 / OPENING of them, however large the corpus. ("*", word) stands for any seldom word before `word`.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter[tuple[str, str]] = Counter()
            for text in batch["text"]:
                for part in stretches(text):
                    pair = part.split(None, 2)
                    total[_opening(*pair[:2]) if len(pair) > 1 else ("", "")] += 1
            yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["first", "second", "n"])

    counted = cut(texts.select("text").mapInPandas(counts, "first string, second string, n bigint").groupBy("first", "second").agg(F.sum("n").alias("n")))
    whole = counted.agg(F.sum("n")).first()[0] or 0
    least = max(OPENING_COUNT, whole * OPENING)
    often = {(r[0], r[1]): r[2] for r in counted.where((F.col("n") >= least) & (F.col("first") != "")).collect()}
    seldom = counted.where((F.col("n") < least) & F.col("first").rlike("^[a-z]{4,}$") & F.col("second").rlike("^[a-z]{4,}$"))
    anyone = seldom.groupBy("second").agg(F.sum("n").alias("n")).where(F.col("n") >= 5 * least)
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter[tuple[str, str]] = Counter()
            known = shared.value
            for text in batch["text"]:
                tokens = _DIGITS.sub("0", plain(" \0 ".join(stretches(text)))).split()
                total.update((y, z) for x, y, z in zip(tokens, tokens[1:], tokens[2:]) if (y, z) in known and x != "\0")
            yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["first", "second", "n"])

    within = texts.select("text").mapInPandas(inside, "first string, second string, n bigint").groupBy("first", "second").agg(F.sum("n").alias("n"))
    elsewhere = {(r[0], r[1]): r[2] for r in within.collect()}  # only pairs that are openings
    alone = {pair: n >= OPENING_ALONE * (n + elsewhere.get(pair, 0)) for pair, n in often.items()}
    return alone | {("*", r[0]): False for r in anyone.collect()}


def learn(texts: DataFrame, labels: DataFrame) -> Rules:
    """Rules from the labelled documents of `texts` (doc_id, text) by labels (doc_id, subject)."""
    learnt = Rules(openings=common_openings(texts))
    shared = texts.sparkSession.sparkContext.broadcast(learnt.openings)
    chosen = labels.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_DOCS)

    # at most LABELLED_DOCS rows of an id and a few codes are broadcast, so no text is shuffled
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rows = [(list(s), [" ".join(sorted(words(x))) for x in sentences(t, shared.value)]) for t, s in zip(part["text"], part["subjects"])]
                yield pd.DataFrame(rows, columns=["subjects", "sentences"])

    rows = cut(texts.join(F.broadcast(chosen), "doc_id").mapInPandas(split, "subjects array<string>, sentences array<string>"))
    counted = cut(_word_counts(rows))
    priors = {r.subject: r.n for r in counted.where("word = ''").collect()}  # one row a subject
    n = priors.pop("", 0)
    if not n:
        return learnt
    shares = {s: c / n for s, c in priors.items()}
    enough = F.create_map(*[F.lit(x) for s, p in shares.items() for x in (s, min(WORD_LIFT * p, p + WORD_GAIN * (1 - p)))])
    whole = counted.where(f"word <> '' and subject = '' and docs >= {WORD_DOCS}").select("word", F.col("n").alias("whole"))
    lifted = counted.where("word <> '' and subject <> ''").join(whole, "word").where(F.col("n") / F.col("whole") >= F.try_element_at(enough, F.col("subject")))
    often = {r.word: r.whole for r in lifted.select("word", "whole").distinct().collect()}  # words of the bounded sample
    learnt.inside = frozenset(often)
    if not often:
        return learnt
    found = _mined(rows, {w: i for i, w in enumerate(sorted(often, key=lambda w: (-often[w], w)))}, max(SUPPORT * n, SUPPORT_COUNT))
    for (chosen_words, subject), confidence in sorted(found.items()):
        shorter = (found.get((part, subject), 0.0) for size in range(1, len(chosen_words)) for part in combinations(chosen_words, size))
        if all(confidence > other + GAIN for other in shorter):
            learnt.rules.setdefault(chosen_words, []).append((subject, confidence))
    for _ in range(ROUNDS):
        _recount(rows, learnt)
    learnt.calibration = _calibrated(rows, learnt)
    return learnt


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, subject, n (sentences), docs of labelled sentences; an empty word stands for all, an empty subject for any."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter[tuple[str, str]] = Counter()
            docs: Counter[str] = Counter()
            for subjects, texts in zip(batch["subjects"], batch["sentences"]):
                parts = [t.split() for t in texts]
                docs.update({w for p in parts for w in p})
                each = Counter(w for p in parts for w in ("", *p))
                for s in ("", *subjects):
                    for w, k in each.items():
                        total[w, s] += k
            yield pd.DataFrame([(w, s, k, 0 if s else docs[w]) for (w, s), k in total.items()], columns=["word", "subject", "n", "docs"])

    return rows.mapInPandas(count, "word string, subject string, n bigint, docs bigint").groupBy("word", "subject").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def grow(transactions: list[tuple[tuple[int, ...], tuple[str, ...], int]], least: float, heads: frozenset[int] | None = None, found: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], int, dict[str, int]]]:
    """Frequent sets of up to RULE_WORDS words with their count and that of each code beside them.

    transactions: words as ranks (the most frequent first) in order, codes, count. Each word projects the
    transactions that hold it to the words before it. heads: the words to start from, all if None.
    """
    projected: dict[int, list[tuple[tuple[int, ...], tuple[str, ...], int]]] = {}
    for items, codes, n in transactions:
        for at, item in enumerate(items):
            if heads is None or item in heads:
                projected.setdefault(item, []).append((items[:at], codes, n))
    for item, rows in projected.items():
        total = sum(n for _, _, n in rows)
        if total < least:
            continue
        counts: Counter[str] = Counter()
        for _, codes, n in rows:
            for c in codes:
                counts[c] += n
        yield (*found, item), total, counts
        if len(found) + 1 < RULE_WORDS:
            yield from grow([r for r in rows if r[0]], least, None, (*found, item))


def _mined(rows: DataFrame, ranks: dict[str, int], least: float) -> dict[tuple[tuple[str, ...], str], float]:
    """Confidence by words and subject of the frequent sets that point to a subject.

    A sentence's words count once a document. A shard gets of each transaction the part up to its own last word.
    """
    names = sorted(ranks, key=ranks.get)
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter[tuple[int, tuple[int, ...], tuple[str, ...]]] = Counter()
            for subjects, texts in zip(batch["subjects"], batch["sentences"]):
                for items in {tuple(sorted(shared.value[w] for w in t.split() if w in shared.value)) for t in texts}:
                    for shard, end in {r % SHARDS: i + 1 for i, r in enumerate(items)}.items():
                        total[shard, items[:end], tuple(subjects)] += 1
            yield pd.DataFrame([(k, list(i), list(c), n) for (k, i, c), n in total.items()], columns=["shard", "items", "codes", "n"])

    def mine(part: pd.DataFrame) -> pd.DataFrame:
        total: Counter[tuple[tuple[int, ...], tuple[str, ...]]] = Counter()
        for items, codes, n in zip(part["items"], part["codes"], part["n"]):
            total[tuple(items), tuple(codes)] += n
        heads = frozenset(range(int(part["shard"].iloc[0]), len(names), SHARDS))
        rules = [
            (sorted(names[i] for i in found), subject, both / (whole + DOUBT))
            for found, whole, codes in grow([(i, c, n) for (i, c), n in total.items()], least, heads)
            for subject, both in codes.items()
            if both >= least and both / (whole + DOUBT) >= CONFIDENCE
        ]
        return pd.DataFrame(rules, columns=["words", "subject", "confidence"])

    shards = rows.mapInPandas(project, "shard int, items array<int>, codes array<string>, n bigint").groupBy("shard")  # of the bounded sample
    return {(tuple(r.words), r.subject): r.confidence for r in shards.applyInPandas(mine, "words array<string>, subject string, confidence double").collect()}


def _recount(rows: DataFrame, learnt: Rules) -> None:
    """Confidence of every rule where each labelled sentence counts for the one subject of its document with most evidence."""
    shared = rows.sparkSession.sparkContext.broadcast(learnt)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = shared.value
        for batch in batches:
            total: Counter[tuple[str, str]] = Counter()
            hits: Counter[tuple[str, str]] = Counter()
            for subjects, texts in zip(batch["subjects"], batch["sentences"]):
                among = set(subjects)
                for text in texts:
                    inside = rules.inside.intersection(text.split())
                    told = rules.evidence(inside, among)
                    for chosen, subject, _ in rules.matching(inside):
                        total[" ".join(chosen), subject] += 1
                        hits[" ".join(chosen), subject] += bool(told) and told[0] == subject
            yield pd.DataFrame([(*k, n, hits[k]) for k, n in total.items()], columns=["chosen", "subject", "n", "hits"])

    counted = rows.mapInPandas(count, "chosen string, subject string, n bigint, hits bigint").groupBy("chosen", "subject").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    fresh: dict[tuple[str, ...], list[tuple[str, float]]] = {}
    for r in sorted(counted.collect(), key=lambda r: (r.chosen, r.subject)):  # one row a rule
        if r.hits / (r.n + DOUBT) >= CONFIDENCE:
            fresh.setdefault(tuple(r.chosen.split()), []).append((r.subject, r.hits / (r.n + DOUBT)))
    learnt.rules = fresh


def _calibrated(rows: DataFrame, learnt: Rules) -> list[float]:
    """Share of labelled sentences whose document bears the subject told, by bins of the score, made monotone."""
    shared = rows.sparkSession.sparkContext.broadcast(learnt)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [(shared.value.evidence(shared.value.inside.intersection(t.split())), s) for s, texts in zip(batch["subjects"], batch["sentences"]) for t in texts]
            yield pd.DataFrame([(min(int(t[1] * BINS), BINS - 1), int(t[0] in s)) for t, s in told if t], columns=["bin", "hit"])

    hits = {r.bin: (r.hits, r.n) for r in rows.mapInPandas(judge, "bin int, hit int").groupBy("bin").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")).collect()}
    curve, last = [], 0.0
    for b in range(BINS):
        h, n = hits.get(b, (0, 0))
        last = max(last, (h + 2 * (b + 0.5) / BINS) / (n + 2))
        curve.append(last)
    return curve


def told_sentences(texts: DataFrame, learnt: Rules) -> DataFrame:
    """Sentences with a subject: doc_id, n_sentences (of the document), subject, agrees (with the rest), context (words of no rule)."""
    shared = texts.sparkSession.sparkContext.broadcast(learnt)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, columns = shared.value, ["doc_id", "n_sentences", "subject", "agrees", "context"]
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                parts = [words(s) for s in sentences(text, rules.openings)]
                told = [rules.subject(p) for p in parts]
                counts, others = Counter(t for t in told if t), max(1, len(parts) - 1)
                rows += [(doc, len(parts), t, (counts[t] - 1) / others >= AGREES, sorted(p - rules.inside)) for p, t in zip(parts, told) if t]
                if len(rows) > 10_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return texts.mapInPandas(judge, "doc_id bigint, n_sentences int, subject string, agrees boolean, context array<string>")


def passing_words(told: DataFrame) -> list[str]:
    """Words of wordings that mention subjects only in passing, from all sentences; at most 1 / PASSING_SHARE times a sentence's words."""
    n = told.count()
    context = told.select(F.explode("context").alias("word"), "agrees").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("agrees").cast("int")).alias("rate"))
    bad = context.where((F.col("n") >= PASSING_COUNT) & (F.col("n") >= n * PASSING_SHARE) & (F.col("rate") < PASSING_AGREES))
    return sorted(r[0] for r in bad.select("word").collect())


def subject_areas(documents: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """doc_id, subject, share of the subjects that at least SHARE of a document's sentences deal with.

    labels: doc_id, subject, for some documents; labelled documents are judged like the others. Null, empty and
    blank texts have no subjects; without labels nobody has. A repeated doc_id is judged row by row and gives
    each subject once, with its largest share.
    """
    marked = need(labels, "doc_id", "subject").where("doc_id is not null and subject is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "subject").distinct()
    texts = _texts(documents, key, text)
    told = cut(told_sentences(texts, learn(texts, marked)))
    passing = passing_words(told)
    kept = told.where(~F.arrays_overlap("context", F.split(F.lit(" ".join(passing)), " "))) if passing else told  # one folded literal
    shares = kept.groupBy("doc_id", "subject", "n_sentences").agg((F.count(F.lit(1)) / F.col("n_sentences")).alias("share")).where(F.col("share") >= SHARE)
    return shares.groupBy("doc_id", "subject").agg(F.max("share").alias("share"))


def composition(found: DataFrame) -> DataFrame:
    """Documents and summed shares by subject, to measure the corpus."""
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("share").alias("weight"))
