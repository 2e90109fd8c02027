"""The cascade behind the guards: a token model, and a reviewer for what the model is unsure of.

Both are pluggable. A scorer labels spans of a batch of texts; a reviewer answers prompts. The model sees all texts, the
reviewer only the rows with spans to escalate, so its input is small.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from queue import Empty, Queue
from threading import Thread
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spans

THRESHOLD = 0.75
REVIEW_SECONDS = 10.0
SENTENCES, CONFIRMED_SHOWN = 3, 10
#: (label, score, start, end) of each span of each text; labels may carry B- and I- prefixes.
Scorer = Callable[[list[str]], list[list[tuple[str, float, int, int]]]]
#: The answers to prompts; None where the call failed.
Reviewer = Callable[[list[str]], list[str | None]]
MODEL_SPAN = "struct<label:string,score:double,start_pos:int,end_pos:int>"


def capitalised_words(texts: list[str]) -> list[list[tuple[str, float, int, int]]]:
    """A deterministic stand-in for a model: pairs of capitalised words are persons, the surer the longer they are."""
    return [[("B-PERSON", min(0.99, 0.5 + 0.02 * len(m.group())), m.start(), m.end()) for m in re.finditer(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", t, re.ASCII)] for t in texts]


_LOADED: dict[str, Scorer] = {}


class LoadedOnce:
    """A scorer whose model is loaded on first use, once in each worker, by a function that travels in its place."""

    def __init__(self, load: Callable[[], Scorer]) -> None:
        self.load, self.name = load, uuid4().hex

    def __call__(self, texts: list[str]) -> list[list[tuple[str, float, int, int]]]:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name](texts)


def model_spans(df: DataFrame, key: str, text: str, scorer: Scorer) -> DataFrame:
    """``df`` with a column ``_spans``; a null or empty text is not sent to the model and has none."""

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            some = [i for i, t in enumerate(batch) if t]
            found: list[list] = [[] for _ in batch]
            for i, labelled in zip(some, scorer([batch.iloc[i] for i in some]) if some else []):
                found[i] = [{"label": a, "score": float(b), "start_pos": int(c or 0), "end_pos": int(d or 0)} for a, b, c, d in labelled]
            yield pd.Series(found)

    return df.withColumn("_spans", F.pandas_udf(score, f"array<{MODEL_SPAN}>").asNondeterministic()(F.col(text)))


def model_detections(text: Column, found: Column, threshold: float = THRESHOLD) -> Column:
    sure = lambda s: s["score"] >= threshold
    return F.transform(
        found,
        lambda s, i: F.struct(
            F.regexp_replace(s["label"], "^[BI]-", "").alias("entity_type"), s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), F.substring(text, s["start_pos"] + 1, s["end_pos"] - s["start_pos"]).alias("text"),
            F.when(s["score"] >= 0.9, "high").when(s["score"] >= 0.7, "medium").otherwise("low").alias("confidence"), s["score"].alias("score"), F.lit("cascade-bert").alias("guard_name"), F.lit("bert").alias("source"),
            F.when(sure(s), "confirmed").otherwise("escalate").alias("disposition"), spans.window(text, s["start_pos"], s["end_pos"]).alias("context"), i.alias("ord"),
        ),
    )


def sentence_window(text: Column, start: Column, end: Column, n: int = SENTENCES) -> Column:
    """The sentences of the span and ``n`` on both sides, trimmed; a sentence ends behind marks and white space."""
    marks = spans.find_all(text, r"[.!?]+\s+")
    starts = F.concat(F.array(F.lit(0)), F.transform(marks, lambda m: m["end_pos"]))
    first = F.size(F.filter(starts, lambda s: s <= start)) - 1
    last = F.size(F.filter(starts, lambda s: s < F.greatest(end, start + 1))) - 1
    a = F.get(starts, F.greatest(first - n, F.lit(0)))
    b = F.coalesce(F.get(starts, last + n + 1), F.length(text))
    return F.trim(F.substring(text, a + 1, b - a))


def prompt(text: Column, d: Column, confirmed: Column) -> Column:
    """What a reviewer is asked about a span: its sentences, the suggestion, and what is already sure."""
    known = F.transform(F.slice(confirmed, 1, CONFIRMED_SHOWN), lambda c: F.concat(c["text"], F.lit(" ("), c["entity_type"], F.lit(")")))
    return F.concat(
        F.lit("Text: "), sentence_window(text, d["start_pos"], d["end_pos"]), F.lit("\nSpan: "), d["text"], F.lit("\nSuggested type: "), d["entity_type"], F.lit(" ("), F.format_number(d["score"], 2), F.lit(")\nKnown: "),
        F.when(F.size(known) > 0, F.array_join(known, ", ")).otherwise("none"), F.lit('\nAnswer with JSON {"type": one type or "NONE", "confidence": 0 to 1}.'),
    )


def verdict(answer: Column) -> Column:
    """struct<type, confidence> of the first JSON object in an answer; null if it is none or lacks a field."""
    found = F.from_json(F.regexp_extract(answer, r"\{[^}]+\}", 0), "type string, confidence double")
    return F.when(found["type"].isNotNull() & found["confidence"].isNotNull(), found)


def reviewed(d: Column, answer: Column, failed: Column) -> Column:
    """A failed call leaves the span as it was; no usable answer, or NONE, dismisses it."""
    v = verdict(answer)
    yes = v["type"].isNotNull() & (v["type"] != "NONE")
    kept = d.withField("source", F.lit("llm")).withField("disposition", F.when(yes, "confirmed").otherwise("dismissed"))
    kept = kept.withField("entity_type", F.when(yes, v["type"]).otherwise(d["entity_type"])).withField("score", F.when(yes, v["confidence"]).otherwise(d["score"]))
    kept = kept.withField("confidence", F.when(yes & (v["confidence"] >= 0.9), "high").when(yes & (v["confidence"] >= 0.7), "medium").when(yes, "low").otherwise(d["confidence"]))
    return F.when(failed, d).otherwise(kept)


def with_retry(call: Callable[[str], str], errors: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), timeout: float | None = REVIEW_SECONDS) -> Reviewer:
    """A reviewer from a function for one prompt: one retry on network errors, any other error fails the call.

    A call that takes longer than ``timeout`` seconds counts as a network error; None waits for ever.
    """

    def asked(p: str) -> str:
        if timeout is None:
            return call(p)
        answer: Queue = Queue()

        def run() -> None:
            try:
                answer.put((call(p), None))
            except Exception as e:  # noqa: BLE001
                answer.put((None, e))

        Thread(target=run, daemon=True).start()  # a call that hangs is left behind and does not hold up the worker's end
        try:
            got, error = answer.get(timeout=timeout)
        except Empty:
            raise TimeoutError from None
        if error is not None:
            raise error
        return got

    def review(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            answer = None
            for attempt in (0, 1):
                try:
                    answer = asked(p)
                    break
                except errors:
                    if attempt:
                        break
                except Exception:  # noqa: BLE001
                    break
            out.append(answer)
        return out

    return review


@dataclass(frozen=True)
class Provider:
    """Where prompts go: ``kind`` is none or custom; others need a network and are supplied by the caller as custom."""

    kind: str = "none"
    call: Callable[[str], str] | None = None

    def reviewer(self) -> Reviewer | None:
        return None if self.kind == "none" or self.call is None else with_retry(self.call)


def cascade_result(detections: Column) -> Column:
    """passed, reason, guard_name, score, detections: dismissed spans do not count, informational ones do."""
    counted = F.filter(detections, lambda d: d["disposition"] != "dismissed")
    sources = F.array_join(F.array_distinct(F.transform(counted, lambda d: d["source"])), ", ")
    types = F.array_join(F.array_distinct(F.transform(counted, lambda d: d["entity_type"])), ", ")
    none = F.size(counted) == 0
    return F.struct(none.alias("passed"), F.when(none, "No issues detected").otherwise(F.concat(F.lit("Detected via "), sources, F.lit(": "), types)).alias("reason"), F.lit("cascade").alias("guard_name"), F.coalesce(F.array_max(F.transform(counted, lambda d: d["score"])), F.lit(0.0)).alias("score"), detections.alias("detections"))


def deep_scan(first: DataFrame, key: str, text: str, scorer: Scorer | None, reviewer: Reviewer | None) -> DataFrame:
    """(key, text, result) from rows of key, text and the guards' detections."""
    x = first
    if scorer is not None:
        x = model_spans(x, key, text, scorer)
        extra = spans.without_overlap(model_detections(F.col(text), F.col("_spans")), F.col("detections"))
        x = x.withColumn("detections", F.concat("detections", extra.cast(f"array<{spans.DETECTION}>"))).drop("_spans")
    if scorer is not None and reviewer is not None:
        unsure = F.filter("detections", lambda d: d["disposition"] == "escalate")
        confirmed = F.filter("detections", lambda d: d["disposition"] == "confirmed")
        asked = x.withColumn("_asked", F.transform(unsure, lambda d: prompt(F.col(text), d, confirmed)))

        def answer(batches):
            for batch in batches:
                asked_of = batch.column(batch.schema.get_field_index("_asked")).to_pylist()
                flat = [p for prompts in asked_of for p in prompts]
                got = iter(reviewer(flat) if flat else [])
                answers = pa.array([[next(got) for _ in prompts] for prompts in asked_of], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, answers], [*batch.schema.names, "_answers"])

        # One pass, so guards and model run once; the reviewer is called only for batches that ask something.
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + ", _answers array<string>"
        some = asked.mapInArrow(answer, schema)
        pairs = F.zip_with(unsure, F.col("_answers"), lambda d, a: reviewed(d, a, a.isNull()))
        x = some.withColumn("detections", F.concat(F.filter("detections", lambda d: d["disposition"] != "escalate"), pairs.cast(f"array<{spans.DETECTION}>")))
    return x.select(key, text, cascade_result(F.col("detections")).alias("result"))


def without_dismissed(long: DataFrame, dismissed: DataFrame, key: str) -> DataFrame:
    """Detections but those that a reader has dismissed: ``dismissed`` has the key, start_pos, end_pos and entity_type."""
    marks = ("start_pos", "end_pos", "entity_type")
    d = dismissed.select(F.col(key).alias("_k"), *[F.col(m).alias(f"_{m}") for m in marks]).distinct()
    on = long[key] == d["_k"]
    for m in marks:
        on = on & long[m].eqNullSafe(d[f"_{m}"])
    return long.join(d, on, "left_anti")


def lines(long: DataFrame, key: str, shown: int = 40) -> DataFrame:
    """(key, line): a line to read for each detection, of its type, place, confidence, source and the begin of its text."""
    text = F.when(F.length("text") > shown, F.concat(F.left("text", F.lit(shown)), F.lit("…"))).otherwise(F.coalesce("text", F.lit("")))
    return long.select(key, F.concat_ws(" ", "entity_type", F.concat(F.lit("at "), F.col("start_pos"), F.lit("-"), F.col("end_pos")), F.concat(F.lit("("), F.concat_ws(", ", "confidence", "source", "disposition"), F.lit(")")), text).alias("line"))


def summary(long: DataFrame) -> DataFrame:
    """Counts of detections by source and disposition."""
    return long.groupBy("source", "disposition").agg(F.count("*").alias("n"))


def severity(guard: Column, disposition: Column, confidence: Column) -> Column:
    """How an editor would show a detection."""
    return F.when(disposition == "escalate", "info").when(disposition == "dismissed", "hint").when(guard.isin("secret", "injection"), "error").when(confidence == "high", "warning").otherwise("info")
