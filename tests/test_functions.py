"""Check digits, spans and likeness against plain models."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import checksums, similarity, spans

SHAPES = {
    "luhn": "################", "iban": "DE##################", "ssn": "#########", "mac": "AB:CD:0#:1#:2#:3#", "npi": "1#########", "dea": "AB#######", "nif": "########Z", "nie": "X#######L", "fiscal": "RSSMRA8#A01H501U",
    "vat": "###########", "pesel": "###########", "hetu": "######-###T", "personnummer": "######-####", "steuer": "###########", "abn": "## ### ### ###", "acn": "### ### ###", "au_medicare": "##########", "aadhaar": "#### #### ####",
    "nin": "###########", "rrn": "######-#######", "tnin": "#############", "aba": "#########", "nhs": "### ### ####", "tfn": "#########", "sentinel_year": "####-01-01",
}
KNOWN = {"luhn": "4532015112830366", "iban": "GB82WEST12345698765432", "ssn": "219-09-9999", "mac": "00:1A:2B:3C:4D:5E", "nif": "12345678Z", "nie": "X1234567L", "fiscal": "RSSMRA85T10A562S", "abn": "51824753556", "aba": "021000021", "nhs": "9434765919", "hetu": "131052-308T", "personnummer": "811228-9874", "steuer": "86095742719", "tfn": "123456782", "npi": "1234567893"}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_column_check_is_the_plain_check(spark, name):
    rng = random.Random(name)
    values = ["".join(str(rng.randrange(10)) if c == "#" else c for c in SHAPES[name]) for _ in range(600)]
    if name in ("nif", "nie", "fiscal", "hetu"):
        values = [v[:-1] + rng.choice("ABCDEFGHJKLMNPQRSTVWXYZ0123456789") for v in values]
    values += [KNOWN[name]] if name in KNOWN else []
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.ok for r in df.select("v", checksums.COLUMN_CHECKS[name](F.col("v")).alias("ok")).collect()]
    assert got == [checksums.CHECKS[name](v) for v in values]
    if name in KNOWN:
        assert got[-1]


def test_checks_of_odd_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("abc",)], "v string")
    for name, check in checksums.COLUMN_CHECKS.items():
        if name != "sentinel_year":
            assert not any(r.ok for r in df.select(check(F.col("v")).alias("ok")).collect()), name


ODD = ["", " ", "abc", "X12A4567L", "ABCDEF-GHI1", "." * 16, "GB82É123", "abcd", "ABCDEFGHIJ", "-", "é" * 16, "AB", "12", "0" * 11, "9" * 13, "a" * 400, "1" * 400, "٣" * 11, "XYZ", "X-------L", "811328-9874", "\n", "GB", "12345678é", "RSSMRA85T10A562É", "00:1A:2B:3C:4D:5G", "1899", "99999-01-01"]


def test_checks_never_raise_and_agree_on_odd_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ODD)], "i int, v string")
    got = df.select("i", *[F.coalesce(check(F.col("v")), F.lit(False)).alias(name) for name, check in checksums.COLUMN_CHECKS.items()]).orderBy("i").collect()
    for v, row in zip(ODD, got):
        for name, check in checksums.CHECKS.items():
            assert check(v) is row[name], (name, v)


def test_verhoeff_ignores_leading_zeros():
    assert checksums.verhoeff(2363) and checksums.nin("00000002363") == checksums.verhoeff(2363)


def test_entropy(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("abcd",), ("password1234",)], "v string")
    for r in df.select("v", checksums.entropy_col(F.col("v")).alias("e")).collect():
        assert abs(r.e - checksums.shannon_entropy(r.v)) < 1e-9


def test_dice(spark):
    pairs = [("night", "nacht"), ("a", "a"), ("a", "b"), ("", ""), ("ab ab", "abab"), ("aaaa", "aa"), ("healed", "sealed")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.d for r in df.select(similarity.dice_col(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == pytest.approx([similarity.dice(a, b) for a, b in pairs]) and similarity.dice("healed", "sealed") == pytest.approx(0.8)


def test_windows_apply_above_the_limit_only():
    phrases = ("ignore previous instructions",)
    far = "x" * 90 + " ignore previous instructions " + "y" * 90
    assert similarity.best_rating(far, phrases, True) > similarity.best_rating(far, phrases, False)
    assert similarity.best_rating("z" * 100, phrases, True) == similarity.best_rating("z" * 100, phrases, False)


def _greedy(ds):
    kept = []
    for d in sorted(ds, key=lambda d: (-d[2], d[3])):
        if all(d[0] >= k[1] or d[1] <= k[0] for k in kept):
            kept.append(d)
    return sorted(kept)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from([0.3, 0.5, 0.9])), max_size=7), min_size=1, max_size=12))
def test_spans_against_a_model(spark, groups):
    text = "abcdefghijklmnopqrstuvwxyz0123456789ABCD"
    rows = [(i, text, [{"start_pos": s, "end_pos": s + n, "score": sc, "ord": k, "entity_type": "T"} for k, (s, n, sc) in enumerate(g)]) for i, g in enumerate(groups)]
    kind = "struct<start_pos:int,end_pos:int,score:double,ord:int,entity_type:string>"
    df = spark.createDataFrame(rows, f"i int, text string, d array<{kind}>")
    out = df.select("i", spans.best_disjoint(F.col("d"), kind).alias("best"), spans.coalesced(F.col("d")).alias("joined"), spans.redact(F.col("text"), F.col("d")).alias("red")).collect()
    for r, g in zip(sorted(out), groups):
        ds = [(s, s + n, sc, k) for k, (s, n, sc) in enumerate(g)]
        assert [(b.start_pos, b.end_pos, b.score, b.ord) for b in r.best] == _greedy(ds)
        covered = {p for s, e, *_ in ds for p in range(s, e)}
        assert {p for j in r.joined for p in range(j.start_pos, j.end_pos)} == covered
        assert all(a.end_pos <= b.start_pos for a, b in zip(r.joined, r.joined[1:]))
        plain = r.red.replace("[REDACTED-T]", "")
        assert plain == "".join(c for i, c in enumerate(text) if i not in covered)


def test_offsets_count_code_points(spark):
    df = spark.createDataFrame([("😀 a@b.io x",)], "t string")
    r = df.select(spans.find_all(F.col("t"), r"\w+@[\w.]+")[0].alias("m"), spans.utf16_offset(F.col("t"), F.lit(2)).alias("u")).first()
    assert (r.m.start_pos, r.m.text, r.u) == (2, "a@b.io", 3)
