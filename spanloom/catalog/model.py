"""Rules as plain data, and their translation between regular-expression dialects."""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as _ops
    from re import _parser
except ImportError:  # no gates then
    _ops = _parser = None

#: White space of the rules' dialect beyond what \s means in ASCII.
WIDE_SPACE = "\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
CONTEXT_BOOST = 0.35


@dataclass(frozen=True)
class Rule:
    """One kind of finding: expressions in order, an optional check of the match, and how it is scored."""

    entity_type: str
    patterns: tuple[str, ...]
    family: str
    score: float
    confidence: str
    validator: str | None = None
    words: tuple[str, ...] = ()
    ignore_case: bool = False
    min_entropy: float | None = None

    @property
    def reach(self) -> float:
        """The highest score that the rule can give."""
        return min(1.0, self.score + CONTEXT_BOOST) if self.words else self.score


def _spaces(pattern: str) -> str:
    """Write out what white space is, inside and outside of classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(rf"\s{WIDE_SPACE}" if inside else rf"[\s{WIDE_SPACE}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


def python_regex(pattern: str, ignore_case: bool = False) -> re.Pattern:
    """For Python workers: ASCII classes and borders."""
    return re.compile(_spaces(pattern), re.ASCII | (re.IGNORECASE if ignore_case else 0))


_WORD_AHEAD = re.compile(r"\\d|[A-Za-z0-9]|\[[A-Za-z0-9]|\((?:\?:)?(?:\\d|[A-Za-z0-9]|\[[A-Za-z0-9])")
_WORD_BEHIND = re.compile(r"(?:\\d|[A-Za-z0-9]|[A-Za-z0-9]\])(?:\{\d+(?:,\d*)?\}|[+])?\)?$")


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    r"""For built-in expressions: borders are ASCII (the JVM's \b is not), classes hold no set operators."""
    out, i, inside = [], 0, False
    p = _spaces(pattern)
    while i < len(p):
        two = p[i : i + 2]
        if two == r"\b" and not inside:
            if _WORD_AHEAD.match(p, i + 2) and not _WORD_BEHIND.search(p[:i]):
                out.append(r"(?<!\w)")
            elif _WORD_BEHIND.search(p[:i]) and not _WORD_AHEAD.match(p, i + 2):
                out.append(r"(?!\w)")
            else:
                out.append(r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
            i += 2
        elif p[i] == "\\":
            out.append(two)
            i += 2
        else:
            c = p[i]
            if inside and c in "[&":
                c = "\\" + c
            elif c == "[":
                inside = True
            elif c == "]":
                inside = False
            out.append(c)
            i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def select(rules: tuple[Rule, ...], types: list[str] | None = None, threshold: float | None = None, custom: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """Rules of the wanted types (none or an empty list: all), then custom ones; rules that cannot reach the threshold fall away."""
    kept = tuple(r for r in rules if not types or r.entity_type in types) + tuple(custom)
    return tuple(r for r in kept if threshold is None or r.reach >= threshold)


def rules_of_type(rules: tuple[Rule, ...], entity_type: str) -> Rule | None:
    return next((r for r in rules if r.entity_type == entity_type), None)


def entity_types(rules: tuple[Rule, ...]) -> list[str]:
    return [r.entity_type for r in rules]


def _literals(parsed, fold: bool) -> tuple[str, ...] | None:
    """Substrings one of which every match of a parsed expression holds, the best that it shows; None if it shows none."""
    found: list[tuple[str, ...]] = []
    run = ""
    for op, value in [*parsed, (None, None)]:
        if op is _ops.LITERAL:
            run += chr(value)
            continue
        if len(run) >= 3 or run and not run.isalnum():
            found.append((run,))
        run = ""
        inner = None
        if op is _ops.SUBPATTERN and not value[1] and not value[2]:
            inner = _literals(value[3], fold)
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and value[0] >= 1:
            inner = _literals(value[2], fold)
        elif op is _ops.BRANCH:
            parts = [_literals(x, fold) for x in value[1]]
            inner = tuple(dict.fromkeys(t for p in parts for t in p)) if all(parts) else None
        if inner:
            found.append(inner)
    return max(found, key=lambda f: (min(map(len, f)) - len(f) / 4, -len(f)), default=None)


def _digits_in_a_row(parsed) -> int:
    """How many ASCII digits in a row every match of a parsed expression holds at least."""

    def digits(items) -> bool:
        return all(op is _ops.CATEGORY and v is _ops.CATEGORY_DIGIT or op is _ops.LITERAL and 48 <= v <= 57 or op is _ops.RANGE and 48 <= v[0] <= v[1] <= 57 for op, v in items)

    best = run = 0
    todo = list(parsed)[::-1]
    while todo:
        op, value = todo.pop()
        if op is _ops.SUBPATTERN:
            todo += list(value[3])[::-1]
        elif op is _ops.LITERAL and 48 <= value <= 57 or op is _ops.IN and digits(value):
            run += 1
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and value[0] >= 1 and len(value[2]) == 1 and _digits_in_a_row(value[2]) == 1 and value[2][0][0] in (_ops.LITERAL, _ops.IN):
            run += value[0]
        elif op not in (_ops.AT, _ops.ASSERT, _ops.ASSERT_NOT):
            best, run = max(best, run), 0
            if op is _ops.BRANCH:
                best = max(best, min(map(_digits_in_a_row, value[1])))
            elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and value[0] >= 1:
                best = max(best, _digits_in_a_row(value[2]))
        best = max(best, run)
    return best


def gates(pattern: str, ignore_case: bool = False) -> tuple[tuple[str, ...], bool, int]:
    """(substrings one of which every match holds, whether they are lower-cased, digits in a row that every match holds).

    Derived from the parsed expression, so a gate never hides a match; what the parser does not tell is no gate.
    """
    try:
        parsed = _parser.parse(pattern, re.ASCII | (re.IGNORECASE if ignore_case else 0))
        fold = ignore_case or bool(parsed.state.flags & re.IGNORECASE)
        found = _literals(parsed, fold) or ()
        return tuple(x.lower() for x in found) if fold else found, fold, _digits_in_a_row(parsed)
    except Exception:  # noqa: BLE001  # an expression that only the other dialect knows, or a parser that has moved
        return (), False, 0


def solid(pattern: str, ignore_case: bool = False) -> int:
    """The least length of a match if it can hold nothing but ASCII letters and digits, else 0."""

    def plain(parsed) -> bool:
        for op, value in parsed:
            if op is _ops.LITERAL and value < 128 and chr(value).isalnum() or op in (_ops.AT, _ops.ASSERT, _ops.ASSERT_NOT):
                continue
            if op is _ops.IN and all(o is _ops.CATEGORY and v is _ops.CATEGORY_DIGIT or o is _ops.LITERAL and v < 128 and chr(v).isalnum() or o is _ops.RANGE and (48 <= v[0] and v[1] <= 57 or 65 <= v[0] and v[1] <= 90 or 97 <= v[0] and v[1] <= 122) for o, v in value):
                continue
            if op is _ops.SUBPATTERN and plain(value[3]) or op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and plain(value[2]) or op is _ops.BRANCH and all(map(plain, value[1])):
                continue
            return False
        return True

    try:
        parsed = _parser.parse(pattern, re.ASCII | (re.IGNORECASE if ignore_case else 0))
        return parsed.getwidth()[0] if plain(parsed) else 0
    except Exception:  # noqa: BLE001
        return 0


def may_be_empty(pattern: str) -> bool:
    """Whether an expression may match nothing; taken for yes if the parser does not tell."""
    try:
        return _parser.parse(pattern, re.ASCII).getwidth()[0] == 0
    except Exception:  # noqa: BLE001
        return True
