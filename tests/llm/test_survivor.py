"""Best representatives: spelling of keys, groups, ranks, consensus."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("plumbline.llm")
from plumbline.llm import survivor as S  # noqa: E402


@pytest.mark.parametrize(
    ("kind", "written", "one"),
    [
        ("mark", " Door 8O8B* ", "808B"), ("mark", "D-N371C", "N371C"), ("mark", "DB171c", "B171C"), ("mark", "(597B)", "597B"), ("mark", "794-C", "794C"), ("mark", "#", None), ("mark", None, None), ("mark", "DR 43O", "430"),
        ("room", "Rm. 1025/193", "1025-193"), ("room", "R-411", "411"), ("room", "wing 737", "WING-737"), ("room", "#1012.606 ", "1012-606"), ("room", "", None),
    ],
)
def test_one_spelling(spark, kind, written, one):
    assert spark.createDataFrame([(written,)], "t string").select(S.one_spelling(F.col("t"), kind)).first()[0] == one


def plain_path(a, b):
    """Least costs by plain loops over profiles; the same moves on ties."""
    share = lambda c, whole: sum(c.values()) / whole

    def meet(x, y):
        equal = sum(w * y.get(t, 0.0) for t, w in x.items()) / (a.whole * b.whole)
        p, q = share(x, a.whole), share(y, b.whole)
        return 1.5 * (p * q - equal) + p * (1 - q) + (1 - p) * q

    n, m = len(a.columns), len(b.columns)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                cost[i][j] = min(
                    cost[i - 1][j - 1] + meet(a.columns[i - 1], b.columns[j - 1]) if i and j else 9e9,
                    cost[i - 1][j] + share(a.columns[i - 1], a.whole) if i else 9e9, cost[i][j - 1] + share(b.columns[j - 1], b.whole) if j else 9e9,
                )
    return cost[n][m]


def path_cost(a, b, steps):
    part = S._Costs(a, b)
    return sum(part.meet(i, j, j + 1)[0] if i is not None and j is not None else part.fill_a[i] if j is None else part.fill_b[j] for i, j in steps)


def test_paths_are_the_cheapest(monkeypatch):
    rng = random.Random(4)
    for cells in (1 << 23, 4):
        monkeypatch.setattr(S, "CELLS", cells)
        for _ in range(60):
            a, b = (S.profile_of([(rng.randint(1, 3), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))) for _ in range(rng.randint(1, 3))]) for _ in range(2))
            steps = S.path(a, b)
            assert [i for i, _ in steps if i is not None] == list(range(len(a.columns))) and [j for _, j in steps if j is not None] == list(range(len(b.columns)))
            assert path_cost(a, b, steps) == pytest.approx(plain_path(a, b))


@pytest.mark.parametrize("size", [3, 300, 5000])
def test_long_values_keep_their_columns(size):
    rng = random.Random(size)
    base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
    edited = [["first", *base], [*base[: size // 2], "middle", *base[size // 2 :]], [*base[:-1], "other"], base]
    values = [(1.0, " ".join(words)) for words in edited]
    profile = S.profile_of(values)
    assert profile.winners() == base and S.settle(values) == " ".join(base)
    columns = [i for i, j in S.path(S.Profile.of(values[3][1], 1.0), S.Profile.of(values[0][1], 1.0)) if j is not None and i is not None]
    assert len(columns) == size  # one word in front shifts nothing


def brute(values):
    weights = Counter()
    for v, w in values:
        weights[v] += w
    top = max(weights, key=lambda v: (weights[v], v))
    if weights[top] * 2 > sum(weights.values()):
        return top
    return S.settle([(float(w), v) for v, w in weights.items()])


def test_a_majority_is_what_alignment_gives():
    rng = random.Random(3)
    for _ in range(100):
        values = {" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))): 1.0 for _ in range(4)}
        top = rng.choice(sorted(values))
        values[top] = 5.0
        assert S.settle([(w, v) for v, w in values.items()]) == top


def test_consensus_is_that_of_brute_force(spark):
    rng = random.Random(2)
    words = ["hm", "frame", "door", "90", "min", "x"]
    groups = {k: [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.randint(1, 3)) for _ in range(rng.randint(1, 7))] for k in range(60)}
    df = spark.createDataFrame([(k, v, w) for k, vs in groups.items() for v, w in vs], "k int, value string, w int").select("k", "value", F.col("w").cast("decimal(18,6)").alias("weight"))
    assert {r.k: r.value for r in S.consensus(df, ["k"]).collect()} == {k: brute(vs) for k, vs in groups.items()}


def test_blocks_of_profiles(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(12)]
    values = {" ".join(w for w in [*base[:i], rng.choice("xyz") + str(i), *base[i + 1 :]]) for i in range(12) for _ in range(9)} | {" ".join(base)}
    df = spark.createDataFrame([(1, v, 1) for v in sorted(values)] + [(2, "a b", 1), (2, "a c", 1)], "k int, value string, w int").select("k", "value", F.col("w").cast("decimal(18,6)").alias("weight"))
    assert {r.k: r.value for r in S.consensus(df, ["k"], 3).collect()} == {1: " ".join(base), 2: "a c"}


COLUMNS = (
    "record_id bigint, bid_id string, mark string, door_type string, width_in double, height_in double, thickness_in double, width_raw string, height_raw string, material string, frame string, "
    "hardware_set string, fire_rating string, remarks string, room_number string, source_page int, confidence double, extracted_at timestamp_ntz, weight string, key string"
)


def door(i, mark, room, material=None, frame=None, page=1, bid="b", at="2024-01-01"):
    return (i, bid, mark, None, None, None, None, None, None, material, frame, None, None, None, room, page, 0.5, at, "clash", "clash")


def doors(spark, rows):
    df = spark.createDataFrame([(*r[:17], r[17], *r[18:]) for r in rows], COLUMNS.replace("timestamp_ntz", "string"))
    return df.withColumn("extracted_at", F.col("extracted_at").cast("timestamp_ntz"))


def test_groups_and_ranks(spark):
    rows = [
        door(1, "101A", "101", "STL"), door(2, "Door 101-a", None, "STL", "n/a"), door(3, "D101A", "Rm 101", "OAK", "HM"),  # one group, 3 is fullest
        door(4, "102", "1"), door(5, "102", "2"), door(6, "102", None), door(7, "102", None),  # two rooms: those without a room are a group of their own
        door(8, "103", None, page=5), door(9, "103", None, page=7), door(10, "104", None, at="2024-01-02"), door(11, "104", None, at="2024-01-03"),
        door(12, None, "1"), door(13, "101A", "101", bid=None), door(14, "105", "5"), door(15, "106", "6"), door(16, "106", "6"),
    ]
    out = S.best_records((doors(spark, rows), S.DOORS))
    assert sorted((r.first_id, r.keep_id, r.n_records) for r in out.collect()) == [(1, 3, 3), (6, 6, 2), (8, 9, 2), (10, 11, 2), (15, 15, 2)]
    best = out.where("first_id = 1").first()
    assert best.survivor == {"material": "OAK", "frame": "HM"} and best.agreed["material"] == "STL" and best.written in {"101A", "Door 101-a", "D101A"}


def test_hot_group_and_empty(spark):
    hot = doors(spark, [door(i, "9", "9", "STL" if i % 3 else "OAK") for i in range(400)])
    r = S.best_records((hot, S.DOORS)).collect()
    assert len(r) == 1 and r[0].n_records == 400 and r[0].agreed["material"] == "STL"
    assert S.best_records((hot.where("false"), S.DOORS)).count() == 0
    repeated = doors(spark, [door(1, "9", "9")] * 3)
    assert S.best_records((repeated, S.DOORS)).count() == 0
