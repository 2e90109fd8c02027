"""Matches of whole catalogs in Python workers: places are code points, borders and classes are ASCII."""

from __future__ import annotations

import re
from collections.abc import Callable

from spanloom.catalog.model import CONTEXT_BOOST, Rule, gates, python_regex, solid
from spanloom.functions.checksums import CHECKS, shannon_entropy


try:
    import ahocorasick
except ImportError:  # each gate is then sought by itself
    ahocorasick = None

_DIGITS, _SOLID = re.compile("[0-9]+"), re.compile("[A-Za-z0-9]+")


class Scanner:
    """Text -> rows of detections in the order of rules, expressions and places. It is sent to workers and compiles there."""

    def __init__(self, rules: tuple[Rule, ...], guard: str, threshold: float | None, disposition: str, near: int, context: int) -> None:
        self.rules, self.guard, self.threshold, self.disposition, self.near, self.context = rules, guard, threshold, disposition, near, context
        self._compiled: list[tuple] | None = None
        self._held: Callable[[str], set[int]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_compiled": None, "_held": None}

    def _compile(self) -> list[tuple]:
        out, literals = [], {}
        for r in self.rules:
            for p in r.patterns:
                needed, _, digits = gates(p, r.ignore_case)
                # Sought in the lower-cased text; letters beyond ASCII may change with what stands around them.
                needed = frozenset(literals.setdefault(x.lower(), len(literals)) for x in needed) if all(map(str.isascii, needed)) else frozenset()
                out.append((r, python_regex(p, r.ignore_case), needed, digits, solid(p, r.ignore_case), CHECKS[r.validator] if r.validator else None))
        self._held = self._finder(literals)
        self._asked = any(x[3] for x in out), any(x[4] for x in out)
        return out

    @staticmethod
    def _finder(literals: dict[str, int]) -> Callable[[str], set[int]]:
        """Lower-cased text -> numbers of the literals that it holds."""
        if ahocorasick is None or not literals:
            return lambda low: {i for x, i in literals.items() if x in low}
        automaton = ahocorasick.Automaton()
        for x, i in literals.items():
            automaton.add_word(x, i)
        automaton.make_automaton()
        return lambda low: {i for _, i in automaton.iter(low)}

    def __call__(self, text: str) -> list[tuple]:
        if self._compiled is None:
            self._compiled = self._compile()
        held = self._held(text.lower())
        # Only what some rule asks for is found out.
        longest, longest_run = (max(map(len, p.findall(text)), default=0) if asked else 0 for p, asked in zip((_DIGITS, _SOLID), self._asked))
        out: list[tuple] = []
        for rule, regex, needed, digits, run, check in self._compiled:
            if digits > longest or run > longest_run or needed and held.isdisjoint(needed):
                continue
            for m in regex.finditer(text):
                start, end = m.span()
                if start == end:  # nothing is no finding
                    continue
                if check and not check(m.group()):
                    continue
                if rule.min_entropy is not None and shannon_entropy(m.group(1) if regex.groups and m.group(1) is not None else m.group()) < rule.min_entropy:
                    continue
                score, confidence = rule.score, rule.confidence
                if rule.words:
                    around = text[max(0, start - self.near) : end + self.near].lower()
                    if any(w in around for w in rule.words):
                        score, confidence = min(1.0, score + CONTEXT_BOOST), {"low": "medium"}.get(confidence, "high")
                if self.threshold is not None and score < self.threshold:
                    continue
                out.append((rule.entity_type, start, end, m.group(), confidence, score, self.guard, "regex", self.disposition, text[max(0, start - self.context) : end + self.context], len(out)))
        return out
