"""Pieces, token ids, leaks and subjects: round trips, brute force, held-out accuracy, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("plumbline.llm")
from plumbline.llm import chunks, leakage, subjects, tokens  # noqa: E402


def check_pieces(text, limit, overlap, reach):
    parts = chunks.split_text(text, limit, overlap, reach)
    assert "".join(text[f:e] for _, f, e, _ in parts) == text
    assert all(e - s <= limit and 0 <= f - s <= overlap and f < e for s, f, e, _ in parts)
    return parts


@given(st.text(alphabet="ab .\n-", max_size=400))
@settings(max_examples=200, deadline=None)
def test_pieces_rebuild_the_text(text):
    check_pieces(text, 40, 8, 10)


def test_natural_or_forced():
    rng = random.Random(1)
    for stretch, forced in ((7990, False), (8000, False), (8001, True)):
        for lead in (0, 10, 300, 5000, 9000):
            text = "".join(rng.choice(["word ", "line\n", "end. "]) for _ in range(lead)) + "x" * stretch + " tail" * 3000
            assert any(p[3] for p in check_pieces(text, 8000, 400, 2000)) == forced
    assert chunks.split_text(None) == [] and chunks.split_text("") == [] and chunks.split_text("a" * 8000) == [(0, 0, 8000, False)]


def test_landmarks_are_those_of_a_plain_search():
    rng = random.Random(5)
    for size, letters in ((3000, "abc"), (900, "ab"), (400, "a"), (33, "ab"), (20, "a")):
        text = "".join(rng.choice(letters) for _ in range(size))
        hashes = chunks._hashes(text).tolist()
        plain = chunks._least_around(np.array(hashes, dtype=np.uint64), 40).tolist()
        assert plain == [min(hashes[max(0, i - 40) : i + 41]) for i in range(len(hashes))]
        marks = [0, *chunks._landmarks(text, 40, 120).tolist(), len(text)]
        assert all(0 < b - a <= 120 for a, b in zip(marks, marks[1:]))


def test_an_edit_moves_only_cuts_near_it():
    rng = random.Random(3)
    ends = ([" "], [" "] * 9 + [". "], [" "] * 30 + [".\n"], [" "] * 60 + [".\n\n", "\n--- PAGE 7 ---\n"], [" "] * 400 + ["\n"])
    texts = ["".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(end) for _ in range(12000)) for end in ends]
    kept = asked = 0
    for text in texts:
        cuts = [e for _, _, e, _ in chunks.split_text(text)][:-1]
        for _ in range(60):
            at = rng.randrange(len(text) * 2 // 3)
            added = "".join(rng.choice("abc de.\n") for _ in range(rng.choice([0, 1, 50, 400, 900])))
            gone = rng.choice([0, 0, 10, 300])
            edited = {e for _, _, e, _ in chunks.split_text(text[:at] + added + text[at + gone :])}
            later = [c for c in cuts if c > at + gone][1:]
            assert all(c in edited for c in [c for c in cuts if c < at][:-2])  # nothing moves two cuts before it
            if later:
                asked += 1
                kept += later[0] + len(added) - gone in edited
    assert asked > 100 and kept >= 0.95 * asked, (kept, asked)


def test_piece_queries(spark):
    df = spark.createDataFrame([(1, "a b " * 3000, 9), (2, "x" * 9000, 0), (3, None, 1), (4, "", 1), (5, "short", None), (1, "a b " * 3000, 9)], "bundle_id bigint, full_text string, piece_no int")
    assert sorted(map(tuple, chunks.how_cut(df, "bundle_id", "full_text").collect())) == [(1, "natural"), (2, "forced")]
    assert chunks.pieces(df, "bundle_id", "full_text").where("key = 5").count() == 1
    assert chunks.how_cut(df.where("false"), "bundle_id", "full_text").count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return tokens.vocabulary_path()


def test_ids_are_those_of_the_tokenizer(vocabulary):
    rng = random.Random(4)
    encoder = tokens.encoder(vocabulary)
    alphabet = list("ab1'’s t\n\r\t  \xa0é中👷‍♂️.,-_A9　\x85\x1cñ'S'll <|endoftext|>")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert encoder.encode(text) == encoder.encoding.encode_ordinary(text)
        assert "".join(encoder.fragments(text)) == text
        assert encoder.encoding.decode(encoder.encode(text)) == text
    assert encoder.encode("word " * 50000) == encoder.encoding.encode_ordinary("word " * 50000)


def test_cuts_are_forced(vocabulary):
    inside = tokens.inner_pairs({b"ab": 0, b"b c": 1})
    assert inside[ord("a"), ord("b")] and inside[ord("b"), ord(" ")] and not inside[ord("c"), ord(" ")]
    assert tokens.certain_cuts(np.ones((256, 256), dtype=bool)).split("a b1") == ["a b1"]  # nothing forced, nothing cut


def test_encode(spark, vocabulary):
    df = spark.createDataFrame([(1, "Slab on grade", "x"), (2, "", "x"), (3, None, "x"), (1, "Slab on grade", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode(df, "doc_id", "text").collect())
    assert got[0] == got[1] and got[2:] == [(2, []), (3, [])] and tokens.encode(df, "doc_id", "text").dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert tokens.encode(df.where("false"), "doc_id", "text").count() == 0


def runs(text):
    w = leakage.words(text)
    return {tuple(w[i : i + leakage.RUN]) for i in range(len(w) - leakage.RUN + 1)}


def test_paraphrases_are_found(spark):
    """Recall of paraphrases against every part beside every passage, without the latent search."""
    rng = random.Random(12)
    common = ["the", "of", "roof", "panel", "drain", "wall", "and", "to", "crew", "price", "report", "under"]
    name = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice([name(), str(rng.randint(10, 9999))]) for _ in range(rng.randint(20, 50)))) for i in range(40)]
    docs = []
    for d in range(200):
        words = [rng.choice([*common, name()]) for _ in range(rng.randint(10, 90))]
        source = rng.choice(items)[1].split()
        at = rng.randint(0, len(source) - 18)
        part = [w if w not in common or rng.random() < 0.6 else rng.choice(["some", "other", "words"]) for w in source[at : at + 18]]
        if d % 2:
            words[5:5] = part
        docs.append((d, " ".join(words)))
    held = leakage.Items.of(items)
    owner, rows = held.parts()
    known = [np.array([held.vocabulary.get(w, -1) for w in leakage.words(t)], dtype=np.int64) for _, t in docs]
    blocks = [leakage.passages_of(k, 9) for k in known]
    space = leakage.latent_space(spark.createDataFrame([(p.tolist(),) for b in blocks for p in b], "passage array<int>"), held)
    asked = leakage.answer_words(rows, space)
    true = set()
    for (d, _), block in zip(docs, blocks):
        for passage in block:
            present = (rows[:, :, None] == passage[None, None, :]).any(2)
            for k in np.flatnonzero((present.sum(1) >= leakage.PARAPHRASE_SHARE * leakage.RUN) & leakage.has_answer(present, held.numeric[rows], asked)):
                if leakage.common_subsequence(rows[k], passage) >= leakage.PARAPHRASE_SHARE * leakage.RUN:
                    true.add((held.ids[owner[k]], d))
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")
    got = {(r.item_id, r.doc_id) for r in found.collect()}
    assert len(true) > 40 and len(got & true) >= 0.9 * len(true), (len(got & true), len(true))


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(6)
    common = ["the", "of", "roof", "panel", "drain", "wall", "and", "to"]
    name = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice([name(), str(rng.randint(10, 9999))]) for _ in range(rng.randint(5, 45)))) for i in range(30)]
    items += [(98, items[0][1]), (99, None)]
    docs = []
    for d in range(150):
        words = [rng.choice([*common, name()]) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            source = (rng.choice(items[:30])[1]).split()
            at = rng.randint(0, max(0, len(source) - 1))
            part = source[at : at + rng.randint(8, 30)]
            if d % 2:
                part = [w.upper() + "," if rng.random() < 0.3 else w for w in part]
            if d % 4 == 0 and len(part) > 3 and len(part[2]) > 3:
                part[2] = part[2][:2] + "-\n" + part[2][2:]
                part[0] = part[0][:1] + "​" + part[0][1:]
            where = rng.randint(0, len(words))
            words[where:where] = part
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "the roof"), (903, "the wall and " * 30000 + items[1][1])]
    expected = {(i, d) for i, t in items for d, b in docs if runs(t) & runs(b)}
    corpus = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, passage string")
    held = spark.createDataFrame(items, "item_id bigint, text string")
    found = leakage.leaks(corpus, "doc_id", "text", held, "item_id", "text")
    assert {(r.item_id, r.doc_id) for r in found.where("kind = 'verbatim'").collect()} == expected and len(expected) > 20
    assert leakage.leaks(corpus.where("false"), "doc_id", "text", held, "item_id", "text").count() == 0
    assert leakage.leaks(corpus, "doc_id", "text", held.where("item_id = 99"), "item_id", "text").count() == 0


def test_paraphrases_of_any_part_and_of_few_words(spark):
    held = spark.createDataFrame([(1, "77 alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"), (2, "ant bee cat dog elk fox gnu hen ibex jay koi lion")], "item_id bigint, text string")
    docs = [
        (1, "alpha bravo charlie delta echo foxtrot zz golf hotel india juliet kilo lima"),  # its nearest part has a number, the next one none
        (2, "ant bee cat dog yy elk fox gnu hen ibex"),  # 9 of the 12 words of the item, 10 in all
        (3, "ant bee cat dog yy elk fox gnu hen"),
    ]
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", held, "item_id", "text")
    assert {(r.item_id, r.doc_id, r.kind) for r in found.collect()} == {(1, 1, "paraphrase"), (2, 2, "paraphrase")}


def test_paraphrases_are_those_of_brute_force():
    rng = random.Random(4)
    items = leakage.Items.of([(i, " ".join(rng.choice([f"w{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 3))}", str(rng.randint(10, 99))]) if rng.random() < 0.3 else f"x{chr(97 + rng.randint(0, 25))}" for _ in range(rng.randint(12, 40)))) for i in range(20)])
    size, blocks = len(items.vocabulary), []
    for _ in range(300):
        source = items.texts[rng.randrange(20)]
        at = rng.randint(0, len(source) - 12)
        body = [w for w in source[at : at + 24] if rng.random() > 0.15]
        blocks.append((body + [-1] * 24)[:24])
    passages = np.array(blocks, dtype=np.int64)
    space = leakage.Space(np.ones(size), np.eye(size, dtype=np.float32))
    use = leakage.Searcher(items, space, True)
    cosine = leakage._unit(leakage._times(leakage._weights(passages, space.idf), 300, space.basis)) @ use.latent.T
    got = list(use.search(np.arange(300), passages))
    verbatim = {(i, d) for i, d, kind, _ in got if kind == "verbatim"}
    expected = {
        (items.ids[use.owner[k]], d)
        for d, k in zip(*np.nonzero(cosine >= leakage.PARAPHRASE_COSINE))
        if leakage.common_subsequence(use.rows[k], passages[d]) >= 8.4 and {w for w in use.rows[k] if items.numeric[w]} <= set(passages[d])
    }
    assert {(i, d) for i, d, kind, _ in got if kind == "paraphrase"} == expected - verbatim and len(expected - verbatim) > 50


def test_sums_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "FAN_IN", 3)
    rows = spark.range(40).selectExpr("id doc_id", "array_repeat(cast(id as int), 24) passage").repartition(11)

    def add(total, block):
        total += block.sum(0)[:2]

    assert leakage._summed(rows, (2,), add).tolist() == [780.0, 780.0]


def test_words_and_subsequence():
    assert leakage.words("Roof-\n  ing 3/4 A­B​c\r\nself-perform") == ["roofing", "3", "4", "abc", "self", "perform"] and leakage.words(None) == []
    assert leakage.common_subsequence(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 1])) == 2


SUBJECTS = {"roof": ["membrane", "flashing", "parapet"], "pipe": ["valve", "drain", "riser"], "wire": ["feeder", "panelboard", "conduit"]}
FRAMES = ["Please confirm the {} before the {} goes in.", "Reported again on day 5: the {} clashes with the {}.", "Who owns the {} scope near the {}?"]


def corpus_of(rng, n):
    docs, truth = [], []
    for d in range(n):
        mine = rng.sample(list(SUBJECTS), rng.choice([1, 1, 2]))
        parts = [rng.choice(FRAMES).format(*(rng.choice(SUBJECTS[mine[k % len(mine)]]) for _ in range(2))) for k in range(8)]
        parts += ["The next meeting is at 9:00."] * 2 + [f"The {rng.choice(SUBJECTS[rng.choice(list(SUBJECTS))])} is handled in a separate letter."]
        rng.shuffle(parts)
        docs.append((d, rng.choice([" ", "\n"]).join(parts)))
        truth.append(set(mine))
    return docs, truth


def test_subjects_on_held_out_documents(spark):
    docs, truth = corpus_of(random.Random(7), 240)
    labels = [(d, s) for d in range(0, 240, 3) for s in truth[d]] + [(3, "wire"), (None, "roof"), (9999, "roof")]
    df = spark.createDataFrame([(*x, "clash") for x in [*docs, (900, None), (901, " "), (902, "Nothing here.")]], "doc_id bigint, text string, subject string")
    found: dict[int, set] = {}
    for r in subjects.subject_areas(df, "doc_id", "text", spark.createDataFrame(labels, "doc_id bigint, subject string")).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    held = [d for d in range(240) if d % 3]
    assert sum(found.get(d, set()) == truth[d] for d in held) >= 0.97 * len(held) and not {900, 901, 902} & set(found)
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    assert subjects.subject_areas(df, "doc_id", "text", none).count() == 0
    assert subjects.subject_areas(df.where("false"), "doc_id", "text", none).count() == 0


def test_sentences():
    openings = {("photo", "0:"): True, ("reported", "again"): True, ("the", "fan"): False, ("*", "quoted"): False}
    assert subjects.sentences("7.2 Sod - as shown Photo 5: slab (lab), looking north Reported again on day 3: wet. Next one.", openings) == [
        "7.2 Sod - as shown", "Photo 5: slab (lab), looking north", "Reported again on day 3: wet.", "Next one."
    ]
    assert subjects.sentences("PLEASE CONFIRM WHETHER THE FAN GOVERNS PHOTO 5: SLAB", openings) == ["PLEASE CONFIRM WHETHER THE FAN GOVERNS", "PHOTO 5: SLAB"]
    assert subjects.sentences("- slab: 5 EA, ref A24 The fan is wet, close-up Xerius quoted the slab", openings) == ["- slab: 5 EA, ref A24", "The fan is wet, close-up", "Xerius quoted the slab"]
    assert subjects.sentences(None, {}) == [] and subjects.words("Éa ábc 12") == {"abc"}
