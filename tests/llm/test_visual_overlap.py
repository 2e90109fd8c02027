import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import overlap, queries, visual


def test_terms_in_every_spelling(spark):
    terms = spark.createDataFrame([(1, "Maison Ervélie"), (2, "Opaxis"), (3, None), (4, ""), (5, "Nolvane-7 Depot")], "term_id bigint, term string")
    cases = [
        ("x Maison Ervélie y", 1, False), ("Maison Ervélie", 1, True), (unicodedata.normalize("NFD", "Maison Ervélie"), 1, True), ("Maison Ervelie", 1, None), ("maison ervélie", 1, None), ("Ｏｐａxis", 2, True), ("Орaxis", 2, True),
        ("Op​ax­is", 2, True), ("Opaxiss", 2, None), ("gOpaxis", 2, None), ("Opaxis", 2, False), ("Nolvane‐7　Depot", 5, True), ("", 2, None), (None, 2, None), ("Opaxis and O﻿paxis", 2, True),
    ]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "id int, text string, value string")
    got = {}
    for r in visual.find_terms(df, terms, "id", "text").collect():
        got[(r.id, r.term_id)] = got.get((r.id, r.term_id), False) or r.value != r.term
    for i, (_, term, expected) in enumerate(cases):
        assert got.get((i, term)) == expected, cases[i]
    whole = {r.id for r in visual.find_terms(df, terms, "id", "text", whole=True).where("value <> term").collect()}
    assert 6 in whole and 14 not in whole and 0 not in whole
    assert visual.find_terms(df.limit(0), terms, "id", "text").count() == 0 and visual.find_terms(df, terms.limit(0), "id", "text").count() == 0


def _brute(text, terms):
    """All stretches of a text that look like a term and are not continued, by comparing every stretch with every term."""
    letters = [(i, b) for i, c in enumerate(text) for b in visual._BASES[ord(c)]]
    out = set()
    for i in range(len(letters)):
        for k in range(i + 1, len(letters) + 1):
            word = "".join(b for _, b in letters[i:k])
            if any(word == visual.skeleton(t) for t in terms) and not (i and letters[i - 1][1].isalnum()) and not (k < len(letters) and letters[k][1].isalnum()):
                out.add(word)
    return out


@pytest.mark.parametrize("limit", [1000, 1])
def test_nested_and_overlapping_terms(spark, monkeypatch, limit):
    """Both ways of finding give the same: one automaton, and a join where there are more terms than it holds."""
    monkeypatch.setattr(visual, "AUTOMATON_TERMS", limit)
    names = ["Ivan Petrov", "Petrov Holding", "Petrov", "Holding", "n Pet", "A-B", "Fin"]
    terms = spark.createDataFrame(list(enumerate(names)), "term_id int, term string")
    bold = "".join(chr(0x1D400 + ord(c) - 65) if c.isupper() else chr(0x1D41A + ord(c) - 97) for c in "Petrov")
    texts = ["Ivan Pеtrov Holding", f"({bold})", "Petrᴏᴠ, Ivan Petrov", "A‐B Fin", "Ｆｉｎ ꓝin Ꭼ", "Petrov\u200b Petrova", "Petrov", "petrov", "Ivan Petrov Holding"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = visual.find_terms(df, terms, "id", "text").collect()
    for i, t in enumerate(texts):
        assert {r.term for r in got if r.id == i} == {n for n in names if visual.skeleton(n) in _brute(t, names)}, t
    odd = {(r.id, r.term) for r in got if r.value != r.term}
    assert {(0, "Ivan Petrov"), (0, "Petrov Holding"), (0, "Petrov"), (1, "Petrov"), (2, "Petrov"), (3, "A-B"), (4, "Fin")} == odd
    whole = visual.find_terms(df.union(spark.createDataFrame([(99, "\ufeffPetrov")], df.schema)), terms, "id", "text", whole=True).where("value <> term").collect()
    assert {(r.id, r.term) for r in whole} == {(99, "Petrov")}


def test_mapping_is_the_same_in_columns(spark):
    """The mapping of columns and the skeleton agree for every character that has a plain form."""
    chars = [c for c in {**visual.look_alikes(), **visual.ligatures()} if unicodedata.category(c)[0] in "LN"]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", visual.mapped(F.col("c")).alias("m")).collect()
    assert all(visual.skeleton(r.m) == visual.skeleton(r.c) for r in rows) and sum(r.m.isascii() for r in rows) > 700


def test_many_forms_are_joined(spark, monkeypatch):
    rows = [(1, "Ｋestrova paid, Ｋestrova"), (2, "Kestrova paid"), (3, None), (1, "Ｋestrova paid, Ｋestrova"), (4, "ＡＢ‐Ｃ é")]
    df = spark.createDataFrame(rows, "id int, text string")
    want = sorted(map(str, visual.canonical_texts(df, "id", "text").collect()))
    monkeypatch.setattr(visual, "BROADCAST_FORMS", 0)
    assert sorted(map(str, visual.canonical_texts(df, "id", "text").collect())) == want and "Kestrova paid, Kestrova" in want[0] + want[1]


def test_classes_and_texts(spark):
    rows = [(1, "Ｋestrova paid"), (2, "Kestrova paid"), (3, "Спасибо за сор"), (4, "café Café café"), (5, None), (6, ""), (7, "👨‍👩‍👧 a b"), (2, "Kestrova paid")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.text for r in visual.canonical_texts(df, "id", "text").collect()}
    assert got[1] == got[2] == "Kestrova paid" and got[3] == "Спасибо за сор" and got[5] is None and got[6] == ""
    a, b, c = got[4].split(" ")
    assert a == c and b == "Café" and got[7] == "👨‍👩‍👧 a b"
    assert visual.canonical_texts(df, "id", "text").count() == len(rows) and visual.canonical_texts(df.limit(0), "id", "text").count() == 0


def test_texts_take_the_terms_spelling(spark):
    nfd = unicodedata.normalize("NFD", "Crépon")
    rows = [(1, f"({nfd}), Crépon. Crépon"), (2, "(Орaxis) «ＯＰＡХＩＳ»"), (3, "Zéphyr, " + unicodedata.normalize("NFD", "Zéphyr")), (4, "Ｚorb‐7 Zоrb"), (5, "сор 1️⃣ می‌خواهم"), (6, "ОРАХ")]
    df = spark.createDataFrame(rows, "id int, text string")
    terms = spark.createDataFrame([(1, "Crépon Associés"), (2, "ОРАХ".translate(str.maketrans("ОРАХ", "OPAX"))), (3, None)], "term_id int, term string")
    got = {r.id: r.text for r in visual.canonical_texts(df, "id", "text", terms).collect()}
    assert got == {1: "(Crépon), Crépon. Crépon", 2: "(Opaxis) «OPAXIS»", 3: "Zéphyr, Zéphyr", 4: "Zorb-7 Zorb", 5: "сор 1️⃣ می‌خواهم", 6: "OPAX"}


def test_texts_of_both_tables_take_one_form(spark, tmp_path):
    spark.createDataFrame([(7, "Zorb paid"), (8, None)], "scan_id bigint, text string").write.parquet(f"{tmp_path}/scan_requests.parquet")
    spark.createDataFrame([(7, "Zоrb"), (9, "Рассо")], "detection_id bigint, text string").write.parquet(f"{tmp_path}/detections.parquet")
    spark.createDataFrame([(1, "Opaxis")], "term_id bigint, term string").write.parquet(f"{tmp_path}/watch_terms.parquet")
    got = {tuple(r) for r in queries.p2_texts(spark, str(tmp_path)).select("field", "row_id", "text").collect()}
    assert got == {("scan", 7, "Zorb paid"), ("scan", 8, None), ("detection", 7, "Zorb"), ("detection", 9, "Рассо")}


def _lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        c = [0]
        for j, y in enumerate(b):
            c.append(p[j] + 1 if x == y else max(p[j + 1], c[-1]))
        p = c
    return p[-1]


def test_banded_programming_is_exact():
    rng = random.Random(2)
    pairs = [[np.array([rng.randrange(4) for _ in range(rng.randint(0, 14))], int) for _ in "ab"] for _ in range(1500)]
    least = [rng.randint(1, 12) for _ in pairs]
    want = [_lcs(a.tolist(), b.tolist()) for a, b in pairs]
    assert overlap.common_in_order(*zip(*pairs), least).tolist() == [w if w >= k else 0 for w, k in zip(want, least)]
    assert overlap.common_in_order([], [], []).tolist() == []


def test_segments_are_enough_and_disjoint():
    """However tokens are edited, one of the K+1 segments stays whole with as many edits on its left as segments before it."""
    rng = random.Random(3)
    counts = np.array([rng.choice([1, 50, 5000, 90000]) for _ in range(64)])
    cutter = overlap.Cutter(counts, 0.8, 8)
    for _ in range(3000):
        e = [rng.randrange(rng.choice([4, 64])) for _ in range(rng.randint(8, 40))]
        t = list(e)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = [rng.randrange(64)] * rng.randrange(2)
        if len(t) < 8 or _lcs(e, t) < (need := overlap._least(max(len(e), len(t)), 0.8)):
            continue
        at = []
        for x in (e, t):
            last = np.arange(len(x)) == len(x) - 1
            at.append(cutter.places(np.array(x), last))
        (key, size, cost), (key_t, size_t, _) = at
        cut = cutter.cut(size.tolist(), cost.tolist())
        assert len(cut) == overlap.most_edits(len(e), 0.8) + 1 and all(a + size[a] <= b for a, b in zip(cut, cut[1:]))
        most, longer = len(e) + len(t) - 2 * need, len(t) - len(e)
        assert any(
            size_t[p] and key_t[p] == key[c] and abs(p - c) <= no and (p - c + no) % 2 == 0 and abs(longer - p + c) <= most - no for no, c in enumerate(cut) for p in range(max(0, c - no), min(len(t), c + no + 1))
        )
    with pytest.raises(ValueError):
        overlap.Cutter(counts, 0.5, 8)


@pytest.mark.parametrize("words,rare,hot", [(6, 64, 4096), (60, 64, 4096), (6, 4, 8), (60, 8, 20)])
def test_pairs_against_brute_force(spark, monkeypatch, words, rare, hot):
    """With small bounds most segments are pairs of frequent tokens, and hot ones are matched by stretches of places."""
    monkeypatch.setattr(overlap, "RARE", rare), monkeypatch.setattr(overlap, "HOT", hot), monkeypatch.setattr(overlap, "STRETCH", 4)
    rng = random.Random(words)
    base = [[f"w{rng.randrange(words)}" for _ in range(rng.randint(7, 16))] for _ in range(40)]
    rows = []
    for i in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            k, at = rng.randrange(3), rng.randrange(len(t))
            t[at : at + (k != 0)] = [] if k == 1 else [rng.choice("wW") + str(rng.randrange(words))]
        rows.append((i, rng.choice(["train", "train", "test", "validation"]), t, "s"))
    rows += [(900, "train", None, "s"), (901, "test", [], "s"), (902, None, base[0], "s"), (903, "train", [None] * 9, "s"), (904, "test", [""] * 9, None), rows[0]]
    df = spark.createDataFrame(rows, "example_id bigint, split_name string, tokens array<string>, source string")
    members, links = overlap.near_same(df)
    got = {tuple(sorted((r.key_e, r.key_t))) for r in overlap.pairs_of(members, links).collect()}
    norm = {r[0]: (r[1], [(t or "").lower() for t in r[2]]) for r in rows if r[1] and r[2] and len(r[2]) >= 8}
    want = set()
    for i, (s, a) in norm.items():
        for j, (t, b) in norm.items():
            if s != "train" and t == "train" and _lcs(a, b) >= overlap._least(max(len(a), len(b)), 0.8):
                want.add(tuple(sorted((i, j))))
    assert got == want and want
    of = {r.key: (r.cls, r.links) for r in overlap.classes(members.distinct(), links).collect()}
    assert len(of) == len({r[0] for r in rows if r[1] and r[2] and len(r[2]) >= 8})
    for key, (_, n) in of.items():
        assert n == len({of[b if a == key else a][0] for a, b in want if key in (a, b)})
    report = overlap.report(members, links).collect()
    assert sum(r.records for r in report) == members.where("split <> 'train'").count()
    clash = overlap.near_same(df.withColumns({"cls": F.lit(1), "n": F.lit("x"), "Key": F.lit(None), "side": F.lit(2)}))
    assert {tuple(sorted((r.key_e, r.key_t))) for r in overlap.pairs_of(*clash).collect()} == want and overlap.classes(*clash).count() > 0
    empty = overlap.near_same(df.where(F.lit(False)))
    assert overlap.pairs_of(*empty).count() == 0
