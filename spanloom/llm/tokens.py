"""Encoding and counting of whole text columns with a public tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm import bpe
from spanloom.runtime import ship, spread

_ENCODERS: dict[int, bpe.Encoder] = {}


def _encoder(vocabulary) -> bpe.Encoder:
    """One encoder for each Python worker and vocabulary."""
    key = vocabulary._jid if getattr(vocabulary, "_jid", None) is not None else id(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = bpe.Encoder(vocabulary.value)
    return _ENCODERS[key]


def _vocabulary(df: DataFrame, path: str):
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(path))


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of each row of ``df``; columns of other names do not matter.

    A null or empty text has an empty list. Repeated rows and null keys give a row each; an empty table gives none.
    Texts are encoded whole, however long; the strings of special tokens are ordinary text.
    """
    shared = _vocabulary(df, vocabulary)
    source = spread(df.select(df[key].alias("k"), df[text].alias("t")))
    kind = source.schema["k"].dataType.simpleString()

    def encode(batches):
        packed = _encoder(shared).packed
        for batch in batches:
            parts = [packed(t) for t in batch.column(1).to_pylist()]
            offsets, at = [0], 0
            for p in parts:
                at += len(p) // 4
                offsets.append(at)
            values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["k", "ids"])

    return source.mapInArrow(encode, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with its text replaced by ``out``: the text's number of tokens (0 for null and empty)."""
    shared = _vocabulary(df, vocabulary)
    rest = [c for c in df.columns if c != text]
    source = spread(df.select(*rest, text))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != text] + [f"`{out}` bigint"])

    def count(batches):
        packed = _encoder(shared).packed
        for batch in batches:
            n = pa.array([len(packed(t)) // 4 for t in batch.column(len(rest)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*rest, out])

    return source.mapInArrow(count, schema)
