"""Match plans and catalogue matches against plain loops over all pairs; counted lookups; roll-ups on literal cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from plumbline.functions.similarity import token_set_ratio
from plumbline.operators import matching, rollups, skew

WORDS = "concrete slab grade beam wall paint door frame steel copper pipe duct board tile roof 8 12 in ft".split()


def texts(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def plain(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def test_plan_is_that_of_all_pairs(spark):
    rng = random.Random(1)
    unit = lambda: rng.choice(["EA", "LF", "SET", "LS", "LOT", None])
    rows = [(i, t, rng.choice([None, 10.0, 50.0]), unit()) for i, t in enumerate(texts(rng, 40))] + [(90, "", 1.0, "EA"), (91, None, None, None), (92, "slab", 1.0, "GAL")]
    lines = [(i, t, rng.choice([None, 10.2, 50.0, 0.0]), rng.choice(["EA", "LF", "SET", "LS", "LOT"])) for i, t in enumerate(texts(rng, 120))] + [(500, None, 1.0, "EA")]
    a = spark.createDataFrame(rows, "row_id bigint, description string, quantity double, unit string")
    b = spark.createDataFrame(lines, "line_id bigint, description string, quantity double, unit string")
    got = {r.row_id: r for r in matching.match_plan(a, b, block=50).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, text, q, u in rows:
        scored = []
        for j, other, lq, lu in lines:
            if u and lu and u != lu and not any({u, lu} <= set(g) for g in matching.COMPATIBLE):
                continue
            x, y = plain(text or ""), plain(other or "")
            boost = 1.02 if q is not None and lq and abs(q - lq) / lq <= 0.05 else 1.0
            scored.append((-(min(1.0, round(SequenceMatcher(None, x, y).ratio() * boost, 4)) if x and y else 0.0), j))
        scored.sort()
        if not scored:
            assert got[i].status == "NO_MATCH"
            continue
        assert (got[i].similarity, got[i].runner_up, got[i].candidates) == (-scored[0][0], -scored[1][0], [j for _, j in scored[:5]])
        assert got[i].line_id == (scored[0][1] if -scored[0][0] >= 0.75 else None)
    assert matching.match_plan(a, b.where("false")).where("status = 'NO_MATCH'").count() == len(rows) and matching.match_plan(a.where("false"), b).count() == 0


def tfidf(texts, fitted):
    terms = lambda t: Counter((w := [x for x in plain(t).split() if len(x) > 1]) + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(k for t in fitted for k in terms(t))
    out = []
    for t in texts:
        raw = {k: n * (math.log((1 + len(fitted)) / (1 + df[k])) + 1) for k, n in terms(t).items() if k in df}
        size = math.sqrt(sum(v * v for v in raw.values()))
        out.append({k: v / size for k, v in raw.items()} if size else {})
    return out


def test_catalogue_match_is_that_of_all_pairs(spark):
    rng = random.Random(2)
    wanted = [(i, t, rng.choice(["LF", "m", None]), rng.choice(["03 30 00", "22", None])) for i, t in enumerate(texts(rng, 15))] + [(99, "unheard words", "LF", None)]
    known = [(i, f"c{i % 4}", t, rng.choice(["lf", "each", "m"]), rng.choice(["concrete slab", "water pipe", None])) for i, t in enumerate(texts(rng, 60))]
    known += [(100 + k[0], *k[1:]) for k in known[:10]]  # copies under other ids count once
    a = spark.createDataFrame(wanted, "wanted_id bigint, description string, unit string, section string")
    b = spark.createDataFrame(known, "row_id bigint, code string, description string, unit string, category string")
    got = {}
    for r in matching.catalogue_match(a, b, first=1000).collect():
        got.setdefault(r.wanted_id, []).append((r.place, r.similarity))
    vectors, asked = tfidf([k[2] for k in known], [k[2] for k in known]), tfidf([w[1] for w in wanted], [k[2] for k in known])
    spell = {"LF": "lf", "m": "m", "lf": "lf", "each": "ea"}
    for (i, _, u, section), q in zip(wanted, asked):
        best = {}
        for (_, code, text, lu, category), v in zip(known, vectors):
            cosine = round(sum(w * v.get(k, 0.0) for k, w in q.items()), 9)
            if cosine <= 0:
                continue
            x, y = spell.get(u), spell[lu]
            factor = 1.0 if x is None else 1.1 if x == y else 0.85 if {x, y} == {"lf", "m"} else 0.55
            hints = {"03": matching.DIVISION_HINTS["03"], "22": matching.DIVISION_HINTS["22"]}.get((section or "")[:2], ())
            bonus = min(0.05, 0.015 * sum(h in (category or "") for h in hints))
            score = max(0.0, min(1.0, round(cosine, 6) * factor + bonus))
            best[code, lu, text] = max(best.get((code, lu, text), 0.0), score)
        expected = sorted(best.values(), reverse=True)[:5]
        assert [s for _, s in sorted(got.get(i, []))] == [__import__("pytest").approx(e, abs=2e-4) for e in expected], i


def test_counted_lookup(spark, monkeypatch, rows):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id bigint, k string")
    counts = left.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.upper("k"))
    plain_inner, plain_left = rows(left.join(counts.drop("n"), "k")), rows(left.join(counts.where("k <> 'k0'").drop("n"), "k", "left"))
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    assert rows(skew.counted_lookup(left, counts, ["k"], "n")) == plain_inner
    assert rows(skew.counted_lookup(left, counts.where("k <> 'k0'"), ["k"], "n", "left")) == plain_left
    assert "BroadcastHashJoin" in skew.counted_lookup(left, counts, ["k"], "n")._jdf.queryExecution().toString()


def test_unnumbered_rooms_merge_by_name(spark):
    rooms = [(1, "b", None, "Main Lobby", None), (2, "b", None, "lobby, main", 5.0), (3, "b", "101", "Office", None), (4, "b", "101", None, 7.0), (5, "b", None, None, 1.0), (6, "b", "", "Storage", 2.0), (7, "c", None, "Main Lobby", 3.0), (8, "b", None, " ", 4.0)]
    df = spark.createDataFrame(rooms, "id bigint, bid string, number string, name string, area double")
    got = sorted((r.id, r.bid, r.number, r.name, r.area, r.n_rows) for r in rollups.merge_rooms(df, "bid", "number", "name", "id", ["area"]).collect())
    assert token_set_ratio("main lobby", "lobby main") == 100.0
    assert got == [(1, "b", None, "Main Lobby", 5.0, 2), (3, "b", "101", "Office", 7.0, 2), (5, "b", None, None, 1.0, 1), (6, "b", None, "Storage", 2.0, 1), (7, "c", None, "Main Lobby", 3.0, 1), (8, "b", None, " ", 4.0, 1)]
    assert rollups.merge_rooms(df.where("false"), "bid", "number", "name", "id", ["area"]).count() == 0


def test_titles_and_sections(spark, rows):
    packages = spark.createDataFrame([(1, "a.pdf", "03", "Concrete"), (2, "b.pdf", "03", ""), (3, "c.pdf", None, None)], "at int, pdf string, number string, trade string")
    refs = spark.createDataFrame([(1, "a.pdf"), (2, "03"), (3, "b.pdf"), (4, "c.pdf"), (5, None), (6, " "), (7, "zz")], "id int, ref string")
    got = dict(rows(rollups.titled(refs, "ref", packages, ["pdf", "number"], ["trade", "pdf"], "at").select("id", "title")))
    assert got == {1: "Concrete", 2: "Concrete", 3: "b.pdf", 4: "c.pdf", 5: "(general)", 6: "(general)", 7: "(unknown: zz)"}
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "x")], "n int, s string").withColumn("g", F.lit(1))
    assert [r.opens_section for r in rollups.section_opens(df, ["g"], "s", ["n"]).orderBy("n").collect()] == [True, False, True, False, True]
