"""A text for each rule of the catalogs, made from the rule itself, so that every rule is seen to find something.

An example of an expression is walked out of its parsed form with a seeded generator; where the rule has a check or a least
entropy, examples are drawn until one passes and one fails. Each customer's key chooses one of the texts, in both engines.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.catalog import pii, secrets
from spanloom.catalog.model import Rule, python_regex
from spanloom.functions.checksums import CHECKS, shannon_entropy
from spanloom.operators import guards
from spanloom.plans import sql
from spanloom.runtime import ship, spread, table

TRIES, MORE_TRIES = 3_000, 25
_PRINTABLE = "".join(map(chr, range(33, 127)))


def example(parsed, rng: random.Random, groups: dict[int, str] | None = None) -> str:
    """A string that a parsed expression matches, look-around aside."""
    from re import _constants as ops

    groups, out = {} if groups is None else groups, []
    for op, value in parsed:
        if op is ops.LITERAL:
            out.append(chr(value))
        elif op is ops.NOT_LITERAL or op is ops.ANY:
            out.append(rng.choice([c for c in "abcdef0123" if op is ops.ANY or ord(c) != value]))
        elif op is ops.IN:
            out.append(rng.choice(_class(value)))
        elif op is ops.BRANCH:
            out.append(example(rng.choice(value[1]), rng, groups))
        elif op is ops.SUBPATTERN:
            text = example(value[3], rng, groups)
            if value[0] is not None:
                groups[value[0]] = text
            out.append(text)
        elif op is ops.GROUPREF:
            out.append(groups.get(value, ""))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high = value[0], min(int(value[1]), value[0] + 4)
            out += [example(value[2], rng, groups) for _ in range(rng.randint(low, high))]
    return "".join(out)


@lru_cache(maxsize=None)
def _members(items: tuple) -> str:
    from re import _constants as ops

    chosen, negated = set(), False
    for op, v in items:
        if op is ops.NEGATE:
            negated = True
        elif op is ops.LITERAL:
            chosen.add(chr(v))
        elif op is ops.RANGE:
            chosen |= {chr(c) for c in range(v[0], min(v[1], 126) + 1)}
        elif op is ops.CATEGORY:
            chosen |= set({ops.CATEGORY_DIGIT: "0123456789", ops.CATEGORY_WORD: "abcXYZ019_", ops.CATEGORY_SPACE: " "}.get(v, "-"))
    return "".join(sorted(set(_PRINTABLE) - chosen if negated else chosen & set(_PRINTABLE + " ") or {" "}))


def _class(items: list) -> str:
    return _members(tuple((op, tuple(v) if isinstance(v, (list, tuple)) else v) for op, v in items))


def _examples(rule: Rule, number: int) -> list[str]:
    """For each expression one string that the rule finds, and for the first one that its check or entropy turns down."""
    from re import _parser

    out = []
    for j, p in enumerate(rule.patterns):
        rng, regex = random.Random(f"{rule.entity_type} {number} {j}"), python_regex(p, rule.ignore_case)
        parsed = _parser.parse(p, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))
        good = bad = None
        left = TRIES
        while left:
            left -= 1
            t = example(parsed, rng)
            m = regex.search(f"x {t} y")
            if m is None or m.group() != t:
                continue
            value = m.group(1) if regex.groups and m.group(1) is not None else t
            fits = (not rule.validator or CHECKS[rule.validator](t)) and (rule.min_entropy is None or shannon_entropy(value) >= rule.min_entropy)
            if fits and not good:
                good, left = t, min(left, 0 if bad or j or not (rule.validator or rule.min_entropy) else MORE_TRIES)
            elif not fits and not bad:
                bad, left = t, 0 if good else left
        out += [t for t in (good, bad) if t]
    return out


@lru_cache(maxsize=None)
def samples(rules: tuple[Rule, ...]) -> tuple[str, ...]:
    """Texts with each example, once with a word around that the rule looks for, if it does."""
    out = []
    for i, r in enumerate(rules):
        for k, t in enumerate(_examples(r, i)):
            out.append(f"see {t} there")
            if r.words and not k:
                out.append(f"the {r.words[-1]}: {t} here")
    return tuple(dict.fromkeys(out))


#: (name, rules, texts) of each family of personal data and each category of secrets.
FAMILIES = tuple((name, rules, samples(rules)) for name, rules in [(f"pii_{f}", tuple(r for r in pii.RULES if r.family == f)) for f in dict.fromkeys(r.family for r in pii.RULES)] + [(f"secret_{f}", tuple(r for r in secrets.RULES if r.family == f)) for f in dict.fromkeys(r.family for r in secrets.RULES)])


def detections(spark: SparkSession, d: str, rules: tuple[Rule, ...], samples: tuple[str, ...]) -> DataFrame:
    """What all rules of a family find in the texts, each customer with one of them."""
    ship(spark)
    text = F.get(F.array(*[F.lit(s) for s in samples]), (F.col("c_custkey") % len(samples)).cast("int"))
    x = spread(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), text.alias("text")))
    x = x.select("key", F.inline(guards.wide(F.col("text"), rules, "planted", None)))
    return x.select("key", "entity_type", "start_pos", "end_pos", F.col("text").alias("match"), "confidence", "score", "ord")


def detections_sql(rules: tuple[Rule, ...], samples: tuple[str, ...]) -> str:
    texts = f"SELECT c_custkey AS k, [{', '.join(map(sql.literal, samples))}][c_custkey % {len(samples)} + 1] AS body FROM customer"
    return f"WITH {sql.scan(texts, rules, 'planted', None)} SELECT k AS key, entity_type, start_pos, end_pos, text AS match, confidence, score, ord FROM s"
