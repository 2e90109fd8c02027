"""Spans of text as arrays of structs: finding, context, overlap, redaction. All stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_CHARS = 150
DETECTION = (
    "struct<entity_type:string,start_pos:int,end_pos:int,text:string,confidence:string,score:double,"
    "guard_name:string,source:string,disposition:string,context:string,ord:int>"
)


#: Elements that are gathered at once: arrays are copied when they grow, so long ones grow block by block.
BLOCK = 256
ALL = (1 << 31) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(xs: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step`` gives out for each element, in order: (state, element) -> (state, output of type ``kind``)."""
    pair = lambda s, out: F.struct(s.alias("state"), out.alias("out"))

    def inside(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return pair(after, F.array_append(acc["out"], out))

    def block(acc: Column, own: Column) -> Column:
        return F.aggregate(own, pair(acc["state"], F.array().cast(f"array<{kind}>")), inside, lambda a: pair(a["state"], F.array_append(acc["out"], a["out"])))

    def blocks(own: Column) -> Column:
        whole = F.aggregate(own, pair(state, F.array().cast(f"array<{kind}>")), inside, lambda a: a["out"])
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(own) <= BLOCK, whole).otherwise(F.flatten(F.aggregate(cut, pair(state, F.array().cast(f"array<array<{kind}>>")), block, lambda a: a["out"])))

    return let(xs, blocks)


MATCH = "struct<start_pos:int,end_pos:int,text:string>"


def find_all(text: Column, regex: str) -> Column:
    """array<struct<start_pos, end_pos, text>> of the matches, which must not be empty; places count code points from 0."""

    def placed(found: Column) -> Column:
        # Most expressions match nowhere; the split is made only where they do.
        pairs = F.zip_with(F.slice(F.split(text, regex, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        return F.when(F.size(found) > 0, folded(pairs, F.lit(0), step, MATCH)).otherwise(F.array().cast(f"array<{MATCH}>"))

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        at = pos + F.length(x["gap"])
        end = at + F.length(x["m"])
        return end, F.struct(at.alias("start_pos"), end.alias("end_pos"), x["m"].alias("text"))

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), placed)


def window(text: Column, start: Column, end: Column, chars: int = CONTEXT_CHARS) -> Column:
    """The span with ``chars`` characters on both sides, cut at the text's ends."""
    left = F.greatest(F.lit(0), start - chars)
    return F.substring(text, left + 1, end + chars - left)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start_pos"] < b["end_pos"]) & (a["end_pos"] > b["start_pos"])


def in_order(spans: Column, *keys: tuple[str, bool]) -> Column:
    """Sorted by fields; True is descending."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, down in reversed(keys):
            lower, higher = (F.lit(1), F.lit(-1)) if down else (F.lit(-1), F.lit(1))
            out = F.when(a[name] < b[name], lower).when(a[name] > b[name], higher).otherwise(out)
        return out

    return F.array_sort(spans, compare)


def _groups(ordered: Column) -> Column:
    """The spans, ordered by start, as an array of groups; a group has no overlap with another."""

    def first_of_group(end: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(end, x["end_pos"]), x["start_pos"] >= end

    def cut(xs: Column) -> Column:
        opens = folded(xs, F.lit(-(1 << 31)), first_of_group, "boolean")
        starts = F.filter(F.transform(opens, lambda o, i: F.when(o, i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda i, k: F.slice(xs, i + 1, F.coalesce(k, F.size(xs)) - i)))

    return let(ordered, lambda xs: F.when(F.size(xs) > 1, cut(xs)).otherwise(F.filter(F.array(xs), lambda g: F.size(g) > 0)))


def best_disjoint(spans: Column, element: str = DETECTION) -> Column:
    """Greedy: the best scores first, earlier ones among equals; each is kept if it overlaps none kept; ordered by place.

    Only spans of one group can overlap, so each group is decided by itself.
    """

    def best(group: Column) -> Column:
        ranked = in_order(group, ("score", True), ("ord", False))
        kept = F.aggregate(ranked, F.array().cast(f"array<{element}>"), lambda acc, x: F.when(F.exists(acc, lambda k: overlaps(k, x)), acc).otherwise(F.array_append(acc, x)))
        return F.when(F.size(group) == 1, group.cast(f"array<{element}>")).otherwise(in_order(kept, ("start_pos", False), ("ord", False)))

    return F.flatten(F.transform(_groups(in_order(spans, ("start_pos", False), ("ord", False))), best)).cast(f"array<{element}>")


def without_overlap(spans: Column, others: Column) -> Column:
    """Interval anti-join inside a row: spans that overlap none of ``others``."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: overlaps(s, o)))


def coalesced(spans: Column) -> Column:
    """array<struct<start_pos, end_pos, entity_type>>: overlapping spans joined, of the type of the first."""
    ranked = in_order(F.transform(spans, lambda s: F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), s["entity_type"].alias("entity_type"))), ("start_pos", False), ("end_pos", True), ("entity_type", False))

    def joined(g: Column) -> Column:
        first = F.get(g, F.lit(0))
        return F.struct(first["start_pos"].alias("start_pos"), F.array_max(F.transform(g, lambda s: s["end_pos"])).alias("end_pos"), first["entity_type"].alias("entity_type"))

    return F.transform(_groups(ranked), joined).cast("array<struct<start_pos:int,end_pos:int,entity_type:string>>")


def replaced(text: Column, spans: Column) -> Column:
    """Each of the disjoint, ordered spans replaced by its tag: the pieces are cut from what is left of the text and joined once."""

    def piece(state: Column, s: Column) -> tuple[Column, Column]:
        gone = F.struct(s["end_pos"].alias("pos"), F.substring(state["left"], s["end_pos"] - state["pos"] + 1, F.lit(ALL)).alias("left"))
        return gone, F.concat(F.substring(state["left"], F.lit(1), s["start_pos"] - state["pos"]), F.lit("[REDACTED-"), s["entity_type"], F.lit("]"))

    pieces = folded(spans, F.struct(F.lit(0).alias("pos"), text.alias("left")), piece, "string")
    return F.concat(F.array_join(pieces, ""), F.substring(text, F.coalesce(F.try_element_at(spans, F.lit(-1))["end_pos"], F.lit(0)) + 1, F.lit(ALL)))


def _replaced_from_the_right(text: Column, spans: Column) -> Column:
    """Each of the ordered spans replaced by its tag where it stood, whatever the ones behind it have done to the text."""
    return F.aggregate(
        F.reverse(spans), text,
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start_pos"]), F.lit("[REDACTED-"), s["entity_type"], F.lit("]"), F.substring(t, s["end_pos"] + 1, F.length(t))),
    )


def redact(text: Column, spans: Column) -> Column:
    """Safe redaction: overlapping spans are joined before they are replaced."""
    return let(coalesced(spans), lambda s: replaced(text, s))


def redact_compatible(text: Column, spans: Column) -> Column:
    """Redaction without regard to overlaps, right to left by start; overlapping spans garble the text. Opt-in."""
    return _replaced_from_the_right(text, in_order(spans, ("start_pos", False), ("ord", True)))


def utf16_offset(text: Column, pos: Column) -> Column:
    """A place in code points as one in UTF-16 units."""
    head = F.substring(text, F.lit(1), pos)
    return pos + F.length(F.regexp_replace(head, "[^\\x{10000}-\\x{10FFFF}]", ""))
