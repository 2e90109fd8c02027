"""Dice likeness of strings over pairs of neighbouring characters, white space aside, letter case counted."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, STEP, WHOLE_UP_TO = 80, 30, 100
_SPACE = re.compile(r"\s+")


def bigrams(s: str) -> Counter:
    s = _SPACE.sub("", s)
    return Counter(s[i : i + 2] for i in range(len(s) - 1))


def dice(a: str, b: str) -> float:
    a, b = _SPACE.sub("", a), _SPACE.sub("", b)
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    return 2 * (bigrams(a) & bigrams(b)).total() / (len(a) + len(b) - 2)


def _pairs_of(s: str) -> np.ndarray:
    """Pairs of neighbouring characters as numbers."""
    points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points[:-1] << 21 | points[1:]


class _Phrases:
    """Phrases by their pairs: each pair has a number, each phrase its counts by number."""

    AT_ONCE = 256

    def __init__(self, phrases: tuple[str, ...]) -> None:
        plain = [_SPACE.sub("", p) for p in phrases]
        self.whole, self.lengths = frozenset(plain), np.array([len(p) for p in plain])
        self.pairs = np.unique(np.concatenate([_pairs_of(p) for p in plain]))
        self.counts = np.stack([np.bincount(np.searchsorted(self.pairs, _pairs_of(p)), minlength=len(self.pairs)) for p in plain]).astype(np.int16)

    def best(self, s: str, parts: np.ndarray, least: float = 0.0) -> float:
        """The highest likeness of a stretch of a string without white space; what stays below ``least`` may count as 0."""
        sizes, longest = parts[:, 1] - parts[:, 0], int(self.lengths.max()) - 1
        if any(s[a:b] in self.whole for a, b in parts[np.isin(sizes, self.lengths) | (sizes < 2)].tolist()):
            return 1.0
        # Even the longest phrase is too short to be like a much longer stretch.
        parts = parts[(sizes >= 2) & (2 * longest >= least * (sizes - 1 + longest))]
        if not len(parts):
            return 0.0
        pairs = _pairs_of(s)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        known = np.flatnonzero(self.pairs[at] == pairs)
        numbers, width = at[known], len(self.pairs)
        low, high = np.searchsorted(known, parts[:, 0]), np.searchsorted(known, parts[:, 1] - 1)
        # Nor can any phrase share more pairs than the stretch has known ones.
        some = np.flatnonzero(2 * (high - low) >= least * (parts[:, 1] - parts[:, 0] + int(self.lengths.min()) - 2))
        best = 0.0
        for i in range(0, len(some), self.AT_ONCE):
            own = some[i : i + self.AT_ONCE]
            n = high[own] - low[own]
            row = np.repeat(np.arange(len(own)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[own], n)
            held = np.minimum(np.bincount(row * width + numbers[place], minlength=len(own) * width), 32_767).reshape(len(own), width).astype(np.int16)
            shared = np.minimum(held[:, None, :], self.counts[None]).sum(2, dtype=np.int64)
            best = max(best, float((2 * shared / ((parts[own, 1] - parts[own, 0])[:, None] + self.lengths[None] - 2)).max()))
        return best


_KNOWN: dict[tuple[str, ...], _Phrases] = {}


def best_rating(text: str, phrases: tuple[str, ...], windows: bool, least: float = 0.0) -> float:
    """The highest likeness of the lower-cased text to a phrase; with ``windows`` of any full window of a long text too.

    A likeness below ``least`` may be given as 0.
    """
    low = text.lower().strip()
    if phrases not in _KNOWN:
        _KNOWN[phrases] = _Phrases(phrases)
    bare = _SPACE.sub("", low)
    parts = np.array([[0, len(bare)]])
    if windows and len(low) > WHOLE_UP_TO:
        # Where a place of the text stands among its characters that are no white space.
        kept = np.ones(len(low), np.int64)
        for m in _SPACE.finditer(low):
            kept[m.start() : m.end()] = 0
        before = np.concatenate([[0], np.cumsum(kept)])
        starts = np.arange(0, len(low) - WINDOW + 1, STEP)
        parts = np.concatenate([parts, np.stack([before[starts], before[starts + WINDOW]], 1)])
    return _KNOWN[phrases].best(bare, parts, least)


def dice_col(a: Column, b: Column) -> Column:
    """The same of two columns, in the JVM."""

    def strip(c: Column) -> Column:
        return F.regexp_replace(c, r"\s+", "")

    def pairs(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: c.substr(i, F.lit(2)))

    x, y = strip(a), strip(b)
    px, py = pairs(x), pairs(y)
    shared = F.aggregate(F.array_distinct(px), F.lit(0), lambda n, p: n + F.least(F.size(F.filter(px, lambda q: q == p)), F.size(F.filter(py, lambda q: q == p))))
    return F.when(x == y, 1.0).when((F.length(x) < 2) | (F.length(y) < 2), 0.0).otherwise(2.0 * shared / (F.length(x) + F.length(y) - 2))
