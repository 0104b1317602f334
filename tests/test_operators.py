"""Core operators on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.functions import measures, similarity, text
from plumbline.functions.rounding import to_places
from plumbline.operators import classify, lookups, matching, records, reports, search
from plumbline.operators.skew import salted_lookup
from plumbline.sources import files
from plumbline.sources.tables import need
from plumbline.streaming import latest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("value", "places", "rounded"), [(0.125, 2, 0.13), (2.675, 2, 2.68), (1.005, 2, 1.01), (45.225, 2, 45.23)])
def test_rounding(spark, value, places, rounded):
    assert one(spark, lambda c: to_places(c, places), value, "double") == rounded


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (measures.feet_inches, "7'-0\"", 84.0), (measures.feet_inches, "3 ft 5 3/4 in", 41.75), (measures.feet_inches, "abc", None), (measures.ceiling_feet, "9'-6\"", 9.5), (measures.ceiling_feet, "10", 10.0),
        (measures.cost_delta, "Add ($1,234.50)", -1234.5), (measures.cost_delta, "$____ add", None), (measures.cost_delta, "450 USD", 450.0), (measures.cost_delta, "12 units", None),
        (measures.dollars, "about $3.2M", 3.2e6), (measures.dollars, "$750K", 7.5e5), (measures.period, "Issued March 2024", "2024-03"), (measures.period, "Q3 2025", "2025-Q3"), (measures.period, "1st quarter 2024", "2024-Q1"),
        (measures.period, "2024-11 index", "2024-11"), (measures.alternate_id, "Alt #1", "Alternate 1"), (measures.alternate_id, "ALT-1", "Alternate 1"), (measures.alternate_id, "VE item 3", "VE-3"),
        (measures.alternate_id, "Bid Alternate No. 2", "Bid Alternate 2"), (measures.area, "~1,250 SF", 1250.0), (measures.area, "TBD", None), (measures.voltage, "208V/3", 208), (measures.phases, "480/3", 3),
        (text.norm, " A-b  C!", "a b c"), (text.norm_description, "03 30 00 - Slab on grade", "slab on grade"), (text.html_text, "<p>a &amp; <b>b</b></p><script>x</script>", "a & b"), (text.html_title, "<TITLE> x </TITLE>", "x"),
        (text.code_block_json, "ok\n```json\n{\"a\": 1}\n```", '{"a": 1}'), (text.header_key, "ROOM #1", "ROOM"),
    ],
)
def test_scalars(spark, function, value, expected):
    assert one(spark, function, value) == expected


def test_text_helpers(spark):
    assert one(spark, text.notes_map, "source=a; mark=101; x; mark=102") == {"source": "a", "mark": "102"}
    assert one(spark, lambda c: text.head_and_tail(c, 6, "~"), "abcdefghij") == "abc~hij"
    assert one(spark, lambda c: text.holds_mark(c, F.lit("10A")), "door 10a, new") and not one(spark, lambda c: text.holds_mark(c, F.lit("10")), "door 1010")


@pytest.mark.parametrize(("s", "c"), [(0.0, 0.45), (0.49, 0.45), (0.5, 0.65), (0.7499, 0.65), (0.75, 0.6375), (0.92, 0.92), (1.4, 1.0), (-1.0, 0.45)])
def test_confidence_steps(spark, s, c):
    assert one(spark, classify.price_confidence, s, "double") == pytest.approx(c)


def test_bands_and_headers(spark):
    assert one(spark, lambda c: classify.band(c, F.lit(False)), 0.85, "double") == "AUTO"
    assert one(spark, lambda c: classify.band(c, F.lit(True)), 0.99, "double") == "HAND"
    assert one(spark, lambda c: classify.band(c, F.lit(False)), None, "double") == "REVIEW"
    kinds = {"door": ["DOOR", "MARK", "WIDTH"], "room": ["ROOM", "AREA", "MARK"]}
    assert one(spark, lambda c: classify.best_header_match(c, kinds), ["Room #", "AREA"], "array<string>") == "room"
    assert one(spark, lambda c: classify.best_header_match(c, kinds), ["X"], "array<string>") is None


def test_page_sample(spark):
    assert one(spark, records.page_sample, 2, "int") == [0, 1]
    assert one(spark, records.page_sample, 10, "int") == list(range(10))
    assert one(spark, records.page_sample, 100, "int") == [0, 1, 2, 3, 4, 20, 35, 50, 65, 80, 95, 96, 97, 98, 99]
    assert one(spark, records.page_sample, 0, "int") == []


def test_dedupe_and_votes(spark, rows):
    df = spark.createDataFrame([(1, "a", "x", 0.0), (2, "a", "x", 3.0), (3, "a", None, 3.0), (4, "b", "", None)], "id bigint, k string, t string, q double")
    assert rows(records.most_complete(df, ["k"], ["t", "q"], "id").select("k", "id", "first_seen")) == [("a", 2, 1), ("b", 4, 4)]
    assert rows(records.vote(df, ["k"], "t")) == [("a", "x", 2)]
    assert rows(records.first_filled(df, ["k"], ["q"], "id")) == [("a", 0.0, 3), ("b", None, 1)]
    docs = spark.createDataFrame([(1, "long/p", "same"), (2, "b/p", "same"), (3, "a/p", "same"), (4, "z", None)], "id bigint, path string, text string")
    assert [(r.id, r.copies) for r in records.distinct_content(docs, "text", "path").collect()] == [(3, 3)]


def test_merges(spark):
    df = spark.createDataFrame([(1, "k", 1.0, 0.5, ["a"]), (2, "k", 3.0, 0.9, ["b", "a"]), (3, None, 2.0, 0.7, [])], "id bigint, k string, q double, c double, s array<string>")
    merged = {r.k: r for r in records.merge_quantities(df, ["k"], "q", "c", "s").collect()}
    assert (merged["k"].quantity, merged["k"].confidence, merged["k"].sources) == (4.0, 0.8, ["a", "b"]) and merged[None].sources == []
    folded = {r.k: r for r in records.fold_quantities(df, ["k"], "q", "c", "id").collect()}
    assert (folded["k"].quantity, folded["k"].confidence) == (4.0, 0.8)


def test_clusters_and_lines(spark, rows):
    assert similarity.token_set_ratio("paint the wall", "wall paint the") == 100.0 and similarity.token_set_ratio("", "a") == 0.0
    df = spark.createDataFrame([(1, "b", "paint wall red"), (2, "b", "red wall paint"), (3, "b", "pour slab")], "id bigint, block string, text string")
    assert rows(records.leader_clusters(df, "block", "text", "id", 88.0).select("text", "leader")) == [("paint wall red", "paint wall red"), ("pour slab", "pour slab"), ("red wall paint", "paint wall red")]
    words = spark.createDataFrame([(1, 5.0, 0.0, "b"), (1, 1.0, 3.0, "a"), (1, 1.0, 5.0, "c"), (1, 1.0, 9.5, "d")], "page int, x double, y double, t string")
    assert [(r.row_no, r.cells) for r in records.cluster_lines(words, "page", "x", "y", "t").orderBy("row_no").collect()] == [(0, ["a", "b"]), (1, ["c"]), (2, ["d"])]


def test_leaders_are_those_of_the_plain_fold(spark, tmp_path):
    """Edits at the start, other orders and spellings: as comparing each text with every leader."""
    from plumbline.plans import catalogue

    bodies = ["GC excludes sod repair at the north lawn of the school", "Contractor excludes sod repair at the north lawn of the school", "at the north lawn of the school, GC excludes sod repair", "Furnish roof drain", "FURNISH: roof drain!", "drian roof furnish", "by others", "paint by others", "equipment pad: wortotraern model 12", "equipment pad: wortotraern new model 12", "--"]
    bodies += [f"{a} {b} {c} at lobby {n}" for a in ("install", "instal") for b in ("steel door", "stel door", "oak door") for c in ("frame", "frames") for n in (12, 13)]
    rows = [(i, "b", "k", t) for i, t in enumerate(bodies)]
    spark.createDataFrame(rows, "scope_id bigint, bid_id string, scope_kind string, text string").write.parquet(str(tmp_path / "scope_items.parquet"))
    leaders, expected = [], {}
    for t in bodies:
        normed = " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
        if normed:
            found = next(((x, y) for x, y in leaders if similarity.token_set_ratio(x, normed) >= 88.0), (normed, t))
            if found[0] == normed and found not in leaders:
                leaders.append(found)
            expected[t] = found[1]
    got = {r.text: r.leader for r in catalogue.queries()["scope_cluster"](spark, str(tmp_path)).collect()}
    assert got == expected and got[bodies[1]] == bodies[0] and got[bodies[2]] == bodies[0]


def test_replay(spark):
    log = spark.createDataFrame([("k", i, float(i)) for i in range(12)], "k string, at int, v double")
    r = records.replay(log, "k", "at", "v").first()
    assert (r.current, r.before, r.history, r.n_changes) == (11.0, 10.0, [float(i) for i in range(2, 12)], 12)


def test_lookups(spark, rows):
    items = spark.createDataFrame([(1, "03 30 00", "03", "slab"), (2, "03 11 00", "03", "paint wall"), (3, "99", "99", "paint"), (4, "99", "99", "zzz")], "item_id bigint, section string, division string, description string")
    entries = spark.createDataFrame([(1, "03 30 00", "03", ["slab"]), (2, "03 20 00", "03", ["wall"]), (3, "09 91 00", "09", ["paint"])], "entry_id bigint, section string, division string, words array<string>")
    assert rows(lookups.tiered_lookup(items, entries)) == [(1, 1, "section"), (2, 2, "division"), (3, 3, "any"), (4, None, None)]
    series = spark.createDataFrame([("s", "2026-01", 100.0), ("s", "2026-04", 110.0)], "series string, period string, value double")
    wanted = spark.createDataFrame([("s", "2026-03"), ("s", "2025-01"), ("t", "2026-01")], "series string, at string")
    assert rows(lookups.as_of(series, wanted)) == [("s", "2025-01", "2026-01", 100.0, True), ("s", "2026-03", "2026-01", 100.0, False), ("t", "2026-01", None, None, True)]
    pair = spark.createDataFrame([("s", "2026-01", "2026-04"), ("t", "2026-01", "2026-04")], "series string, base string, target string")
    assert rows(lookups.change_factor(series, pair)) == [("s", "2026-01", "2026-04", 1.1), ("t", "2026-01", "2026-04", 1.0)]


def test_antijoin_and_plan(spark, rows):
    lines = spark.createDataFrame([(1, "b", "Door 101A wood"), (2, "b", "door 1010"), (3, "c", "door 101a"), (4, "b", None)], "id bigint, bid string, d string")
    made = spark.createDataFrame([("b", "101A"), ("b", "1")], "bid string, mark string")
    assert rows(lookups.retire_covered(lines, made, "id", "bid", "d", "mark").select("id")) == [(2,), (3,), (4,)]
    quotes = spark.createDataFrame([(1, "slab on grade", 50.0, "SF"), (2, "zzz", None, None), (3, "x", None, "LF")], "row_id bigint, description string, quantity double, unit string")
    costs = spark.createDataFrame([(10, "slab on grade", 50.0, "SF"), (11, "slab on grades", 9.0, "SF"), (12, "slab on grade", 50.0, "EA")], "line_id bigint, description string, quantity double, unit string")
    plan = {r.row_id: (r.status, r.line_id) for r in matching.match_plan(quotes, costs).collect()}
    assert plan[1] == ("AMBIGUOUS", 10) and plan[2][0] == "LOW_SIMILARITY" and plan[3] == ("NO_MATCH", None)


def test_antijoin_marks_with_punctuation(spark, rows):
    lines = spark.createDataFrame([(1, "b", "Door A9.18 wood"), (2, "b", "door a9 and 18"), (3, "b", "door (101-a), new"), (4, "b", "door 101"), (5, "c", "door 101-A"), (6, "b", "door a9-18")], "id bigint, bid string, d string")
    made = spark.createDataFrame([("b", "A9.18"), ("b", "101-A"), ("b", "--")], "bid string, mark string")
    assert rows(lookups.retire_covered(lines, made, "id", "bid", "d", "mark").select("id")) == [(2,), (4,), (5,), (6,)]


def test_geometry(spark, rows):
    rooms = spark.createDataFrame([("b", "1", 100.0, 44.0, 10.0), ("b", "2", 100.0, None, 9.0)], "bid_id string, room string, area_sf double, perimeter_ft double, height_ft double")
    doors = spark.createDataFrame([("b", "1", 36.0, 84.0), ("b", "1", None, None), ("b", "9", 36.0, 84.0)], "bid_id string, room string, width_in double, height_in double")
    openings = lookups.openings_by_room(doors, rooms)
    assert rows(openings) == [("b", "1", 2, 42.0)]
    finishes = spark.createDataFrame([(1, "b", "1", "floor"), (2, "b", "1", "wall_ALL"), (3, "b", "2", "base"), (4, "b", "7", "floor")], "finish_id bigint, bid_id string, room string, surface string")
    assert rows(lookups.backfill(finishes, rooms, openings)) == [(1, "floor", 100.0, "SF", 0.92, None), (2, "wall_ALL", 398.0, "SF", 0.92, None), (3, "base", 40.0, "LF", 0.65, None), (4, "floor", None, "SF", None, "no area")]


def test_search(spark):
    docs = spark.createDataFrame([(50, "red paint for walls"), (1, "red paint for doors"), (2, "pour concrete slab"), (3, "red paint for walls")], "id bigint, text string")
    terms = search.weighted_terms(docs).withColumn("share", F.lit(0.0))
    best = search.search(terms, terms.where("id = 50"), top=1).first()
    assert best.id == 3 and best.score == pytest.approx(1.0)
    vectors = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "id bigint, vector array<double>")
    assert [(r.rank, r.id) for r in lookups.nearest(vectors, top=2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_search_is_exact(spark):
    """Common terms and copies count: the same rows as comparing every query with every text."""
    bodies = ["by others", "by owner", "match existing", "paint by others at lobby", "slab at lobby"]
    docs = [(i, "by others" if i % 3 == 0 else f"{bodies[i % 5]} {i % 7}x {i % 11}y") for i in range(1, 151)]
    terms = search.weighted_terms(spark.createDataFrame(docs, "id bigint, text string"))
    weights: dict[int, dict[str, float]] = {}
    for r in terms.collect():
        weights.setdefault(r.id, {})[r.term] = r.weight
    expected = []
    for query in (50, 100, 150):
        scored = sorted((-round(sum(w * weights[query].get(t, 0.0) for t, w in weights[i].items()), 9), i) for i in weights if i != query)
        expected += [(query, n + 1, i, round(-s, 6)) for n, (s, i) in enumerate(scored[:5]) if s < 0]
    got = [(r.query_id, r["rank"], r.id, r.score) for r in search.search(terms, terms.where("id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert len(got) == 15 and got == [(q, n, i, pytest.approx(s, abs=2e-6)) for q, n, i, s in expected]


def test_reports(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), (None, None)], "k string, v double")
    assert rows(reports.totals_with_shares(df, "k", F.col("v"))) == [("a", 2, 3.0, 0.75), ("b", 1, 1.0, 0.25), (None, 1, 0.0, 0.0)]
    pages = spark.createDataFrame([(1, "x\n--- PAGE 1 ---\na\n--- PAGE 2 ---\nb")], "id int, t string")
    assert rows(reports.pages_of(pages, "id", "t")) == [(1, 1, "a"), (1, 2, "b")]
    lines = spark.createDataFrame([(1, 1, "Alt 1: a"), (1, 2, "more"), (1, 3, " "), (1, 4, "no"), (1, 5, "Alt 2: b")], "d int, n int, t string")
    assert rows(reports.fold_continuations(lines, "d", "n", "t", "^Alt")) == [(1, 1, "Alt 1: a more"), (1, 5, "Alt 2: b")]
    files.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_sources(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("desc,rate,q,uom\npipe,1,2,EA\r\nbad\n")
    raw = files.raw_records(spark, str(tmp_path / "in"))
    assert rows(raw.select("line_no", "raw_line")) == [(1, "desc,rate,q,uom"), (2, "pipe,1,2,EA"), (3, "bad")]
    assert files.contents(spark, str(tmp_path / "in"), "*.csv").count() == 1 and files.listed(spark, str(tmp_path / "in"), "*.csv", most_mb=0.00001).count() == 0
    snaps = spark.sql("select 's' source, 'x' series, 'EA' unit, double(1) value, null region, '2026-01' period, timestamp_ntz'2026-01-01' fetched_at union all select 's', 'x', 'EA', double(2), null, '2026-01', timestamp_ntz'2026-02-01'")
    files.write_snapshots(snaps, str(tmp_path / "snap"))
    assert [r.value for r in files.latest(spark.read.parquet(str(tmp_path / "snap"))).collect()] == [2.0]
    with pytest.raises(Exception, match="unsafe"):
        spark.createDataFrame([("..",)], "t string").select(files.safe_token(F.col("t"))).collect()


def test_stream_equals_batch(spark, rows, tmp_path):
    events = spark.sql("select id event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 7, 0) ts, concat('s', id % 3) k, double(id) v from range(60)")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = latest.windowed(stream, "ts", "k", "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("w")) == rows(latest.windowed(events, "ts", "k", "v"))
    q = latest.latest_per_series(stream, "k", "ts", "v").writeStream.format("memory").queryName("l").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("l")) == rows(latest.latest_per_series(events, "k", "ts", "v"))


def test_salted_lookup_and_need(spark, rows):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(9)], "id bigint, k string")
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    assert salted_lookup(left, right, ["k"], "id", "left").count() == 9 and salted_lookup(left, right, ["k"], "id").count() == 6
    with pytest.raises(ValueError):
        need(left, "nope")
