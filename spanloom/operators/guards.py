"""Guards: text in, detections out, as columns.

A guard has two tiers that give the same detections. The narrow tier builds column expressions, one for each rule and
expression, and stays in the JVM; it serves a few rules. The wide tier hands whole catalogs to one Arrow function that
returns the matches with their scores. Everything behind the matches (overlaps, results, redaction, risk) is expressions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.catalog import pii, prompts, secrets
from spanloom.catalog.model import CONTEXT_BOOST, Rule, java_regex, may_be_empty, select
from spanloom.functions import checksums, similarity, spans
from spanloom.operators import matching

CONTEXT_WINDOW = 100
#: Expressions of rules up to which columns are used: each one is another search of the text, and a scan gates its own.
NARROW_EXPRESSIONS = 2
EMPTY = f"array<{spans.DETECTION}>"
RESULT = f"struct<passed:boolean,reason:string,guard_name:string,score:double,detections:array<{spans.DETECTION}>,redacted_text:string>"


@dataclass(frozen=True)
class GuardConfig:
    """``threshold`` None keeps every match; ``mode`` is redact or block."""

    enabled: bool = True
    threshold: float | None = 0.5
    mode: str = "redact"

    def merged(self, overlay: dict | None) -> GuardConfig:
        """A given value replaces the default even if it is None."""
        return replace(self, **{k: v for k, v in (overlay or {}).items() if k in ("enabled", "threshold", "mode")})


def promoted(confidence: str) -> str:
    return {"low": "medium"}.get(confidence, "high")


def _rule_matches(text: Column, lowered: Column, rule: Rule, guard: str, disposition: str) -> list[Column]:
    """Narrow tier: one array for each expression of a rule."""
    out = []
    for pattern in rule.patterns:
        found = spans.find_all(text, java_regex(pattern, rule.ignore_case))
        if rule.validator:
            found = F.filter(found, lambda m: F.coalesce(checksums.COLUMN_CHECKS[rule.validator](m["text"]), F.lit(False)))
        if rule.min_entropy is not None:
            found = F.filter(found, lambda m: checksums.entropy_col(F.coalesce(_group(m["text"], pattern, rule.ignore_case), m["text"])) >= rule.min_entropy)

        def scored(m: Column) -> Column:
            near = spans.window(lowered, m["start_pos"], m["end_pos"], CONTEXT_WINDOW)
            boost = F.lit(False)
            for w in rule.words:
                boost = boost | near.contains(w)
            score = F.when(boost, F.lit(min(1.0, rule.score + CONTEXT_BOOST))).otherwise(F.lit(rule.score)) if rule.words else F.lit(rule.score)
            confidence = F.when(boost, F.lit(promoted(rule.confidence))).otherwise(F.lit(rule.confidence)) if rule.words else F.lit(rule.confidence)
            return F.struct(
                F.lit(rule.entity_type).alias("entity_type"), m["start_pos"].alias("start_pos"), m["end_pos"].alias("end_pos"), m["text"].alias("text"), confidence.alias("confidence"), score.alias("score"),
                F.lit(guard).alias("guard_name"), F.lit("regex").alias("source"), F.lit(disposition).alias("disposition"), spans.window(text, m["start_pos"], m["end_pos"]).alias("context"), F.lit(0).alias("ord"),
            )

        out.append(F.transform(found, scored))
    return out


def _group(match: Column, pattern: str, ignore_case: bool) -> Column:
    """The value inside a match whose expression has a group; null where it has none."""
    import re as _re

    if not _re.compile(pattern).groups:
        return F.lit(None).cast("string")
    return F.regexp_extract(match, java_regex(pattern, ignore_case), 1)


def narrow(text: Column, rules: tuple[Rule, ...], guard: str, threshold: float | None, disposition: str = "confirmed") -> Column:
    lowered = F.lower(text)
    arrays = [a for r in rules for a in _rule_matches(text, lowered, r, guard, disposition)]
    if not arrays:
        return F.array().cast(EMPTY)
    every = F.concat(*[a.cast(EMPTY) for a in arrays])
    if threshold is not None:
        every = F.filter(every, lambda d: d["score"] >= threshold)
    numbered = F.transform(every, lambda d, i: d.withField("ord", i))
    return F.when(text.isNull(), F.array().cast(EMPTY)).otherwise(numbered)


_ARROW = pa.list_(pa.struct([
    ("entity_type", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("text", pa.string()), ("confidence", pa.string()), ("score", pa.float64()),
    ("guard_name", pa.string()), ("source", pa.string()), ("disposition", pa.string()), ("context", pa.string()), ("ord", pa.int32()),
]))


Scan = Callable[[str], list[tuple]]


def _packed(texts: list, scan: Scan) -> pa.Array:
    """The rows of a scan of each text as an array of detections; a null or empty text has none."""
    names = [f.name for f in _ARROW.value_type]
    offsets, columns = [0], [[] for _ in names]
    for t in texts:
        for row in scan(t) if t else ():
            for c, v in zip(columns, row):
                c.append(v)
        offsets.append(len(columns[0]))
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW.value_type)], names)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _arrow_function(scan: Scan) -> Callable[[Column], Column]:
    def run(texts: pa.Array) -> pa.Array:
        return _packed(texts.to_pylist(), scan)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Marked so that the optimizer neither repeats the scan nor moves it into the expressions behind it.
    return F.arrow_udf(run, EMPTY).asNondeterministic()


def scan_all(scans: dict[str, Scan]) -> Callable[[Column], Column]:
    """One function for several scans, so a text travels once: a struct with an array of detections for each name."""

    def run(texts: pa.Array) -> pa.Array:
        plain = texts.to_pylist()
        return pa.StructArray.from_arrays([_packed(plain, scan) for scan in scans.values()], list(scans))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<" + ",".join(f"`{n}`:{EMPTY}" for n in scans) + ">").asNondeterministic()


def wide(text: Column, rules: tuple[Rule, ...], guard: str, threshold: float | None, disposition: str = "confirmed") -> Column:
    return _arrow_function(matching.Scanner(rules, guard, threshold, disposition, CONTEXT_WINDOW, spans.CONTEXT_CHARS))(text)


def _tier(rules: tuple[Rule, ...]) -> str:
    """Both tiers find the same; expressions that may match nothing cannot be columns."""
    return "narrow" if sum(len(r.patterns) for r in rules) <= NARROW_EXPRESSIONS and not any(may_be_empty(p) for r in rules for p in r.patterns) else "wide"


def matches(text: Column, rules: tuple[Rule, ...], guard: str, threshold: float | None, disposition: str = "confirmed", tier: str | None = None) -> Column:
    tier = tier or _tier(rules)
    return (narrow if tier == "narrow" else wide)(text, rules, guard, threshold, disposition)


@dataclass(frozen=True)
class Guard:
    """``detect`` gives array<detection>, ``finish`` treats it as a whole, ``result`` is the verdict over it.

    The three are columns of successive projections. Guards of one's own need a name and ``detect``.
    """

    name: str = ""
    config: GuardConfig = field(default_factory=GuardConfig)
    tier: str | None = None

    def with_config(self, overlay: dict | None) -> Guard:
        return replace(self, config=self.config.merged(overlay))

    def detect(self, text: Column) -> Column:
        raise NotImplementedError

    def scan(self) -> Scan | None:
        """The same as ``finish`` of ``detect`` as a function of one text, where there is one."""
        return None

    def finish(self, detections: Column) -> Column:
        return F.coalesce(detections, F.array().cast(EMPTY))

    def result(self, text: Column, detections: Column) -> Column:
        """passed, reason, guard_name, score, detections and, in redact mode with findings, the redacted text."""
        types = F.array_distinct(F.transform(detections, lambda d: d["entity_type"]))
        none = F.size(detections) == 0
        return F.struct(
            none.alias("passed"), F.when(none, "No issues detected").otherwise(F.concat(F.lit("Detected: "), F.array_join(types, ", "))).alias("reason"), F.lit(self.name).alias("guard_name"),
            F.coalesce(F.array_max(F.transform(detections, lambda d: d["score"])), F.lit(0.0)).alias("score"), detections.alias("detections"),
            (F.when(~none, spans.redact(text, detections)) if self.config.mode == "redact" else F.lit(None).cast("string")).alias("redacted_text"),
        )


def best_disjoint(rows: list[tuple]) -> list[tuple]:
    """The same choice as ``spans.best_disjoint`` over rows of one text."""
    if len(rows) < 2:
        return rows
    starts, kept = [], []  # ordered and disjoint, so only neighbours can overlap
    for r in sorted(rows, key=lambda r: (-r[5], r[10])):
        i = bisect_left(starts, r[1])
        if (not i or kept[i - 1][2] <= r[1]) and (i == len(starts) or r[2] <= starts[i]):
            starts.insert(i, r[1]), kept.insert(i, r)
    return kept


def _scan_of(guard: Guard, rules: tuple[Rule, ...], threshold: float | None, disposition: str = "confirmed", disjoint: bool = False) -> Scan | None:
    """None where the narrow tier is used."""
    if (guard.tier or _tier(rules)) == "narrow":
        return None
    scanner = matching.Scanner(rules, guard.name, threshold, disposition, CONTEXT_WINDOW, spans.CONTEXT_CHARS)
    return (lambda t: best_disjoint(scanner(t))) if disjoint else scanner


@dataclass(frozen=True)
class PiiGuard(Guard):
    name: str = "pii"
    entity_types: tuple[str, ...] = ()
    custom: tuple[Rule, ...] = ()

    def _rules(self) -> tuple[Rule, ...]:
        return select(pii.RULES, list(self.entity_types), self.config.threshold, self.custom)

    def detect(self, text: Column) -> Column:
        return matches(text, self._rules(), self.name, self.config.threshold, tier=self.tier)

    def scan(self) -> Scan | None:
        return _scan_of(self, self._rules(), self.config.threshold, disjoint=True)

    def finish(self, detections: Column) -> Column:
        return spans.best_disjoint(Guard.finish(self, detections))


@dataclass(frozen=True)
class SecretGuard(Guard):
    """Overlapping secrets of different types are all reported."""

    name: str = "secret"
    secret_types: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    custom: tuple[Rule, ...] = ()

    def _rules(self) -> tuple[Rule, ...]:
        base = tuple(r for r in secrets.RULES if not self.categories or r.family in self.categories)
        return select(base, list(self.secret_types), self.config.threshold, self.custom)

    def detect(self, text: Column) -> Column:
        return matches(text, self._rules(), self.name, self.config.threshold, tier=self.tier)

    def scan(self) -> Scan | None:
        return _scan_of(self, self._rules(), self.config.threshold)


@dataclass(frozen=True)
class PromptGuard(Guard):
    """Expressions first; only where none matches, likeness to known phrases decides about the whole text."""

    config: GuardConfig = field(default_factory=lambda: GuardConfig(threshold=0.6, mode="block"))
    kind: str = "injection"

    def scan(self) -> Scan:
        rules, phrases, windows = (prompts.INJECTION_RULES, prompts.INJECTION_PHRASES, True) if self.kind == "injection" else (prompts.LEAKAGE_RULES, prompts.LEAKAGE_PHRASES, False)
        scanner = matching.Scanner(rules, self.name, None, "confirmed", CONTEXT_WINDOW, spans.CONTEXT_CHARS)
        # What the guard needs is read here, so the guard itself does not travel.
        threshold, entity, name = self.config.threshold, rules[0].entity_type, self.name

        def scan(t: str) -> list[tuple]:
            hits = scanner(t)
            if hits or threshold is None:
                return hits
            best = similarity.best_rating(t, phrases, windows, threshold)
            if best < threshold:
                return []
            return [(entity, 0, len(t), t[:200], "high" if best >= 0.8 else "medium", best, name, "regex", "confirmed", t[: len(t) + spans.CONTEXT_CHARS], 0)]

        return scan

    def detect(self, text: Column) -> Column:
        return _arrow_function(self.scan())(text)


def injection_guard(**kw) -> PromptGuard:
    return PromptGuard(name="injection", kind="injection", **kw)


def leakage_guard(**kw) -> PromptGuard:
    return PromptGuard(name="leakage", kind="leakage", **kw)


@dataclass(frozen=True)
class TestDataGuard(Guard):
    """Informational: always passes and never redacts."""

    __test__ = False
    name: str = "testdata"

    def detect(self, text: Column) -> Column:
        return matches(text, prompts.TESTDATA_RULES, self.name, None, "informational", self.tier)

    def scan(self) -> Scan | None:
        return _scan_of(self, prompts.TESTDATA_RULES, None, "informational", disjoint=True)

    def finish(self, detections: Column) -> Column:
        return spans.best_disjoint(Guard.finish(self, detections))

    def result(self, text: Column, detections: Column) -> Column:
        types = F.array_distinct(F.transform(detections, lambda d: d["entity_type"]))
        none = F.size(detections) == 0
        return F.struct(
            F.lit(True).alias("passed"), F.when(none, "No test data detected").otherwise(F.concat(F.lit("Test data detected: "), F.array_join(types, ", "))).alias("reason"), F.lit(self.name).alias("guard_name"),
            F.coalesce(F.array_max(F.transform(detections, lambda d: d["score"])), F.lit(0.0)).alias("score"), detections.alias("detections"), F.lit(None).cast("string").alias("redacted_text"),
        )
