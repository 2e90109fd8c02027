"""Per-document statistics of text, and which messages are no natural prose.

Tables and lists show in their layout: delimiters that stand one below the other (in number, in columns, at the line's
head), indentation that comes back, and lines that all end long before the page does, one after the other. Junk shows in
the ratios of its words, symbols and markup. Each sign adds its weight, the share of text in sentences takes away, and from
a bound on the text is no prose.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import messages
from spanloom.llm.vocabulary import with_vocabulary
from spanloom.runtime import spread

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
OTHER_THAN_DIGITS, OTHER_THAN_ALNUM = re.compile(r"\D+"), re.compile(r"[\W_]+")
FOREIGN = re.compile("[\u0370-\u1dbf\u1f00-\u1fff\u2c00-\u2dff\u3040-\ud7ff\uf900-\ufdff\ufe70-\ufeff]")
BULLET = re.compile(r"^\s*(?:[-*•–—+·▪◦o‣]|\(?\d{1,4}[.)]|[a-zA-Z][.)]|\[[ xX]\])\s+\S")
LEADER = re.compile(r"(?:\.{4,}|(?: \.){4,}|\t)\s*\d+\s*$")
SENTENCE_END = re.compile(r"(?<=[.!?…。！？:])[\"')\]»”’]*(?:\s+|$)|(?<=[。！？])")
TERMINAL = tuple(".!?…。！？:;")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-z]{2,8};")
SHORT_CLOSING = re.compile(r"^[^\W\d_][^\n.:;|,\t]{0,40}[,:!.]?$")
DELIMITERS = {",": 2, "\t": 1, "|": 2, ";": 2, "│": 2, "¦": 2}
HEAD_LETTERS, HEAD_DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
#: Common words that are broadcast; of more, each text gets its own by a join.
MAX_COMMON_WORDS = 200_000
#: Where a page ends: lines are as short as they stay behind it.
PAGE = 72

#: What each sign adds to the case against prose, and what text in sentences takes away; no prose from BOUND.
WEIGHTS = {"alignment": 0.6, "periodicity": 0.6, "autocorrelation": 0.6, "noise": 0.9, "repeated": 0.9, "strange": 0.7, "markup": 0.5, "unfinished": 0.3, "sentences": -1.0}
BOUND = 0.5

STATS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("mean_word_length", T.DoubleType()),
    T.StructField("symbol_ratio", T.DoubleType()), T.StructField("line_end_punctuation", T.DoubleType()), T.StructField("common_word_share", T.DoubleType()),
    T.StructField("digit_ratio", T.DoubleType()), T.StructField("distinct_word_share", T.DoubleType()), T.StructField("bullet_share", T.DoubleType()),
    T.StructField("delimiter_alignment", T.DoubleType()), T.StructField("indent_periodicity", T.DoubleType()), T.StructField("length_autocorrelation", T.DoubleType()),
    T.StructField("sentence_share", T.DoubleType()), T.StructField("structure", T.DoubleType()), T.StructField("is_prose", T.BooleanType()),
])


def periodicity(lines: list[str]) -> float:
    """How well indentation comes back after one to four lines (its autocorrelation), times the share of indented lines; 0 of under 3 lines."""
    xs = [len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip()) for x in lines]
    n = len(xs)
    if n < 3 or not any(xs):
        return 0.0
    mean = sum(xs) / n
    var = sum((x - mean) ** 2 for x in xs)
    best = 1.0 if var == 0 else max(sum((xs[i] - mean) * (xs[i + k] - mean) for i in range(n - k)) / var for k in range(1, min(5, n - 1)))
    return max(0.0, best) * sum(map(bool, xs)) / n


def autocorrelation(lines: list[str]) -> float:
    """Autocorrelation of what lines, blank ones included, leave free of the page; 0 of under 4 lines with text.

    Items of lists and rows of tables leave much free on line after line. Wrapped prose fills its lines but the last of
    each paragraph, and unwrapped prose goes beyond the page.
    """
    if sum(bool(x.strip()) for x in lines) < 4:
        return 0.0
    free = [max(0, PAGE - len(x.rstrip())) if x.strip() else 0 for x in lines]
    squares = sum(x * x for x in free)
    return sum(a * b for a, b in zip(free, free[1:])) / squares if squares else 0.0


def head(line: str) -> str:
    """The shape of a line's first token if it is more than a word: a bullet, a number, a time, a tag, the begin of an address."""
    first = line.split(None, 1)[0][:24]
    shape = HEAD_DIGITS.sub("0", HEAD_LETTERS.sub("a", first))
    bare = shape.rstrip(".,;!?'’\"")
    return "" if bare in ("a", "") and shape[-1:] not in (":",) else "a://" if shape.startswith("a://") else shape


def alignment(lines: list[str]) -> float:
    """Largest share of lines that have the same number of one delimiter, gaps in the same columns, a bullet, leader or head alike; 0 of under 3 lines."""
    n = len(lines)
    if n < 3:
        return 0.0
    best = max(sum(bool(BULLET.match(x)) for x in lines), sum(bool(LEADER.search(x)) for x in lines)) / n
    heads = Counter(filter(None, map(head, lines)))
    if heads:
        best = max(best, heads.most_common(1)[0][1] / n)
    for d, least in DELIMITERS.items():
        counts = Counter(c for c in (x.count(d) for x in lines) if c >= least)
        if counts:
            best = max(best, counts.most_common(1)[0][1] / n)
    columns: Counter = Counter()
    gaps = []
    for x in lines:
        if "  " not in x:
            gaps.append(set())
            continue
        own = {m.end() for m in re.finditer(r"\S {2,}(?=\S)", x.rstrip())} | {-m.start() - 1 for m in re.finditer(r"(?<=\S) {2,}\S", x.rstrip())}
        gaps.append(own)
        columns.update(own)
    kept = {c for c, k in columns.items() if k >= max(3, 0.5 * n)}
    return max(best, sum(1 for own in gaps if own & kept) / n if kept else 0.0)


def statistics(text: str | None, common: frozenset[str]) -> tuple:
    """The values of STATS for one text."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    words = WORD.findall(text)
    compact = "".join(text.split())
    n_words, visible = len(words), len(compact)
    if not visible:
        return (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, True)
    letters = sum(map(len, words))
    low = [w.lower() for w in words]
    digits = len(OTHER_THAN_DIGITS.sub("", compact))
    alnum = len(OTHER_THAN_ALNUM.sub("", compact))
    common_share = sum(w in common for w in low) / n_words if n_words else 0.0
    ends = sum(x.rstrip().endswith(TERMINAL) for x in lines) / len(lines)
    bullets = sum(bool(BULLET.match(x)) for x in lines) / len(lines)
    period, length_auto = periodicity(lines), autocorrelation(text.split("\n"))
    align = alignment(lines)
    distinct = len(set(low)) / n_words if n_words else 0.0
    symbols = (visible - alnum) / visible
    markup = sum(len(m) for m in TAG.findall(text)) / visible

    # Sentences: unwrapped paragraphs, cut behind closing marks. Lines with bullets are none.
    inside = 0
    paragraphs: list[str] = [""]
    for x in text.split("\n"):
        if not x.strip() or BULLET.match(x) or LEADER.search(x):
            paragraphs.append("")
        elif paragraphs[-1].endswith(TERMINAL) or not paragraphs[-1]:
            paragraphs.append(x.strip())
        else:
            paragraphs[-1] += " " + x.strip()
    for p in paragraphs:
        for s in SENTENCE_END.split(p):
            s = s.strip()
            w = WORD.findall(s)
            solid = sum(map(len, w))
            foreign = FOREIGN.search(s) is not None
            if not s.rstrip("\"')]»”’").endswith(TERMINAL) or solid < 0.7 * (len(s) - s.count(" ")):
                continue
            known = sum(x.lower() in common for x in w)
            if (len(w) >= 3 and (known >= 0.15 * len(w) or foreign)) or (foreign and solid >= 6):
                inside += len(s) - s.count(" ")
    greeting = sum(len(x) - x.count(" ") for x in lines[:1] + lines[-1:] if len(lines) > 2 and SHORT_CLOSING.match(x.strip()))
    share = min(1.0, inside / max(1, visible - greeting))

    signs = {
        "alignment": align, "periodicity": period, "autocorrelation": length_auto, "sentences": share,
        "noise": min(1.0, max(0.0, (symbols - 0.2) * 3)), "markup": min(1.0, 2 * markup), "unfinished": 1 - ends,
        "repeated": max(0.0, 1 - distinct * 4) if n_words >= 20 else 0.0, "strange": float(common_share < 0.05 and n_words >= 8),
    }
    structure = sum(WEIGHTS[k] * v for k, v in signs.items())
    prose = structure < BOUND
    return (n_words, len(lines), letters / n_words if n_words else 0.0, symbols, ends, common_share, digits / visible, distinct, bullets, align, period, length_auto, share, structure, prose)


def document_statistics(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", body_only: bool = False) -> DataFrame:
    """(key, has_text, and the columns of STATS) of each row.

    With ``body_only`` the statistics are of the body as its sender wrote it, else of the whole text. Null, empty and
    blank texts have zeros, has_text false and count as prose; repeated rows give a row each. ``common_words`` has word;
    up to MAX_COMMON_WORDS of them are broadcast, more are joined.
    """
    shown = lambda t: messages.body(t) if body_only and t else t or ""
    x = spread(df.select(df[key].alias("k"), df[text].alias("t")))
    x, common_of = with_vocabulary(x, common_words.select(F.lower("word")), MAX_COMMON_WORDS, lambda t, seen: statistics(shown(t), seen))
    names = [f.name for f in STATS]

    def measure(batches):
        for p in batches:
            texts = [shown(t) for t in p["t"]]
            out = pd.DataFrame([statistics(t, common) for t, common in zip(texts, common_of(p))], columns=names)
            out.insert(0, "has_text", [bool(t.strip()) for t in texts])
            out.insert(0, "k", p["k"].to_numpy())
            yield out

    kind = x.schema["k"].dataType.simpleString()
    schema = f"k {kind}, has_text boolean, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STATS)
    return x.mapInPandas(measure, schema).withColumnRenamed("k", key)
