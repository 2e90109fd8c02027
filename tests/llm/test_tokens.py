"""Encoding against the public library, edits against encoding afresh, and odd inputs."""

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import bpe, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary")
ODD = ["", " ", "\n\n  x", "<|endoftext|>", "don't 'S's", "ﬀ é é ​", "日本語 テキスト", "👨‍👩‍👧 ok", "a" * 5000, "=" * 300 + "\r\n\t\t", "١٢٣ ²³ ½", "\x1c\x85\xa0x", "0123456789" * 30, "ſK ΣΑΣ"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary())


@pytest.fixture(scope="module")
def public():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_public_library(encoder, public, data):
    import pandas as pd

    for t in ODD + pd.read_parquet(f"{data}/documents.parquet").text.dropna().tolist():
        assert encoder.encode(t) == public.encode_ordinary(t)
        assert encoder.decode(encoder.encode(t)) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, public, t):
    assert encoder.encode(t) == public.encode_ordinary(t)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c'st1\n é=", max_size=40), st.lists(st.tuples(st.integers(0, 50), st.integers(0, 6), st.text(alphabet="ab s'1\n é=", max_size=5)), max_size=8))
def test_edits_are_exact(encoder, t, edits):
    e = bpe.EditableEncoding(encoder, t)
    for at, n, by in edits:
        at = min(at, len(e.text))
        e.replace(at, min(len(e.text), at + n), by)
        assert e.ids() == encoder.encode(e.text)
    e.append(" tail")
    assert e.ids() == encoder.encode(e.text)


def test_an_edit_computes_only_its_neighbourhood(encoder):
    e = bpe.EditableEncoding(encoder, "several ordinary words stand here. " * 200)
    before = e.computed
    e.replace(3500, 3503, "xyz")
    assert e.computed - before < 100 and e.ids() == encoder.encode(e.text)


def test_columns(spark, encoder):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (1, "hello world", "x"), (4, "z" * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted([(r.doc_id is None, r.doc_id, r.ids) for r in tokens.token_ids(df).collect()], key=str)
    assert got == sorted([(r[0] is None, r[0], encoder.encode(r[1])) for r in rows], key=str)
    assert tokens.token_ids(df.limit(0)).count() == 0
    assert [f.dataType.simpleString() for f in tokens.token_ids(df).schema] == ["bigint", "array<int>"]
    counts = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df.where("doc_id is not null")).collect()}
    assert counts[2] == counts[3] == 0 and counts[1] == len(encoder.encode("hello world"))
