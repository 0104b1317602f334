"""TF-IDF search over short texts, exact over all shared terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from .skew import top_rows

#: Most distinct texts and queries that one task scores against each other, and products it forms at once.
TEXTS, QUERIES, PRODUCTS = 4000, 2000, 2_000_000
#: Scores that agree in so many places are ties; the smaller id goes first.
PLACES = 9


def _terms(texts: DataFrame) -> DataFrame:
    """id, term, tf of one- and two-word terms."""
    words = texts.select("id", F.filter(F.split(norm(F.col("text")), " "), lambda w: F.length(w) > 1).alias("w"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    terms = words.select("id", F.explode(F.when(F.size("w") > 1, F.concat("w", pairs)).otherwise(F.col("w"))).alias("term"))
    return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def weighted_terms(texts: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """id, term, weight: unit-length TF-IDF rows of one- and two-word terms; idf is ln((1 + n) / (1 + df)) + 1.

    n and df are those of the texts themselves or of `fitted` texts, whose terms alone count then.
    """
    counts = _terms(texts)
    base = counts if fitted is None else _terms(fitted)
    n = (texts if fitted is None else fitted).select("id").distinct().count()
    df = base.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = counts.join(df, "term").select("id", "term", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)).alias("raw"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    return raw.join(norms, "id").select("id", "term", (F.col("raw") / F.col("size")).alias("weight"))


def _merged(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, term, weight) of one text for each content, and (kept, id): the kept id that each text is scored by."""
    keyed = terms.groupBy("id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("term", F.round("weight", PLACES).alias("w"))))), 256).alias("content"))
    members = keyed.join(keyed.groupBy("content").agg(F.min("id").alias("kept")), "content").select("kept", "id")
    return terms.join(members.where("kept = id").select("id"), "id", "left_semi"), members


def _best(texts: pd.DataFrame, asked: pd.DataFrame, top: int) -> pd.DataFrame:
    """query_id, id, score: the `top` texts of each query by the sum of the products of all shared terms."""
    known = pd.Index(asked["word"].unique())
    query, queries = pd.factorize(asked["query_id"], sort=True)
    order = np.argsort(known.get_indexer(asked["word"]), kind="stable")
    query, q = query[order], asked["q"].to_numpy()[order]
    ends = np.cumsum(np.bincount(known.get_indexer(asked["word"]), minlength=len(known)))
    texts = texts.sort_values("id", kind="stable")
    row, ids = pd.factorize(texts["id"])
    term, weight = known.get_indexer(texts["term"]), texts["weight"].to_numpy()
    row, term, weight = row[term >= 0], term[term >= 0], weight[term >= 0]
    count = np.diff(ends, prepend=0)[term]
    scores = np.zeros(len(ids) * len(queries))
    upto = np.cumsum(count)
    at = 0
    while at < len(term):  # a stretch of text terms with all their products
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PRODUCTS, "right")))
        n = count[at:end]
        which = np.repeat(np.arange(at, end), n)
        posting = np.arange(len(which)) + np.repeat(ends[term[at:end]] - np.cumsum(n), n)
        first = row[at] * len(queries)
        cells = row[which] * len(queries) + query[posting] - first
        sums = np.bincount(cells, weight[which] * q[posting])
        scores[first : first + len(sums)] += sums
        at = end
    scores = np.round(scores.reshape(len(ids), len(queries)), PLACES)
    least = np.partition(scores, len(ids) - top, axis=0)[len(ids) - top] if len(ids) > top else np.zeros(len(queries))
    i, k = np.nonzero((scores > 0) & (scores >= least))
    found = pd.DataFrame({"query_id": queries[k], "id": ids[i], "score": scores[i, k]})
    return found.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(top)


def search(terms: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """query_id, rank, id, score: the `top` texts of each query by cosine over all shared terms, ties by id.

    terms and queries: as by weighted_terms. Texts that share no term with a query are left out. Copies are merged
    before they are scored. Blocks of texts meet blocks of queries, and each pair of blocks hands on `top` rows a query,
    so no term is too common to count.
    """
    texts, members = _merged(terms)
    asked, askers = _merged(queries)
    asked = asked.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("q"))
    blocks = [max(1, -(-n // most)) for n, most in ((members.select("kept").distinct().count(), TEXTS), (askers.select("kept").distinct().count(), QUERIES))]
    left, right = ("text_block", "query_block")
    texts = texts.join(asked.select("term").distinct(), "term", "left_semi").select(F.pmod(F.xxhash64("id"), F.lit(blocks[0])).alias(left), F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1)).cast("array<bigint>")).alias(right), "id", "term", "weight")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1)).cast("array<bigint>")).alias(left), F.pmod(F.xxhash64("query_id"), F.lit(blocks[1])).alias(right), "query_id", F.col("term").alias("word"), "q")
    kinds = dict(terms.dtypes)["id"], dict(queries.dtypes)["id"]
    found = texts.groupBy(left, right).cogroup(asked.groupBy(left, right)).applyInPandas(lambda t, a: _best(t, a, top + 1), f"query_id {kinds[1]}, id {kinds[0]}, score double")
    # one of the best may be the query itself, hence one more of them and of their copies
    kept = top_rows(found, ["query_id"], [F.desc("score"), F.asc("id")], top + 1).select(F.col("query_id").alias("asker"), F.col("id").alias("kept"), "score")
    copies = top_rows(members, ["kept"], [F.asc("id")], top + 1).select("kept", "id")
    rows = kept.join(copies, "kept").join(askers.select(F.col("kept").alias("asker"), F.col("id").alias("query_id")), "asker").where("id <> query_id").select("query_id", "id", "score")
    return top_rows(rows, ["query_id"], [F.desc("score"), F.asc("id")], top).select("query_id", "rank", "id", F.round("score", 6).alias("score"))
