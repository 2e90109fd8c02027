"""Cutting oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import ship, small_side, spread

#: Boundaries, strongest first; a cut falls behind the match.
BOUNDARIES = tuple(re.compile(p) for p in (r"\n[ \t\r]*\n\s*", r"\n", r"[.!?…]+[\"')\]»”’]*\s+|[。！？]+", r"[,;:)\]}]\s+|[、，；]", r"\s+"))
#: A cut is sought in the middle half of a segment.
WINDOW = 0.25
MAX_MODELS = 10_000


def _joined(text: str, at: int) -> bool:
    """Whether a place stands inside a word, a letter with its accents, an emoji sequence or a line end."""
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    return a.isalnum() and b.isalnum() or bool(unicodedata.combining(b)) or b in "\u200d\ufe0f" or a == "\u200d" or a + b == "\r\n"


def cut_point(text: str, start: int, end: int, overlap: int = 0) -> int:
    """The strongest boundary near the midpoint of ``text[start:end]``, the nearest one of its kind.

    Among those of its kind one comes first behind which the overlap begins at a natural place too.
    """
    mid, reach = (start + end) // 2, max(1, int((end - start) * WINDOW))
    low, high = max(start + 1, mid - reach), min(end - 1, mid + reach)
    for pattern in BOUNDARIES:
        found = [m.end() for m in pattern.finditer(text, max(start, low - 1), high) if low <= m.end() <= high]
        if found:
            return min(found, key=lambda at: (overlap > 0 and _joined(text, at - overlap), abs(at - mid), at))
    cut = mid
    while cut > low and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f\n" or text[cut - 1] == "\u200d"):
        cut -= 1  # not inside a letter with its accents, an emoji sequence or a line end
    return cut if cut > low else mid


def pieces(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open spans of at most ``max_chars``; each but the first begins ``overlap`` characters before the last one's end.

    ``overlap`` is from 0 to ``max_chars`` - 1. No piece lies inside another.
    """
    if max_chars < 1 or len(text) <= max_chars:
        return [(0, len(text))]
    if not 0 <= overlap < max_chars:
        raise ValueError(f"pieces of {max_chars} characters cannot share {overlap}")
    core, spans, todo = max_chars - overlap, [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        if end - start <= core:
            spans.append((max(0, start - overlap), end))
            # What begins with the text and ends earlier lies inside the new piece.
            if len(spans) > 1 and not spans[-1][0]:
                del spans[-2]
        else:
            cut = cut_point(text, start, end, overlap)
            todo += [(cut, end), (start, cut)]
    return spans


def split_oversized(df: DataFrame, models: DataFrame, key: str = "scan_id", text: str = "text", model: str = "model_id", with_text: bool = True) -> DataFrame:
    """(key, piece_no, n_pieces, start_pos, end_pos[, piece]) of each row of ``df``.

    ``models`` has model_id, max_chars, overlap_chars and is_default; a null model means the default one. A text within
    its limit, and one whose model is unknown, is one piece; a limit that is null or below 1 is no limit, a null overlap
    is 0. A model whose overlap is negative or not below its limit is a ValueError when the query is built. Null texts
    give no piece, empty ones one empty piece. Repeated rows give their pieces each. Positions count code points.
    """
    ship(df.sparkSession)
    wrong = models.where("max_chars >= 1 and (overlap_chars < 0 or overlap_chars >= max_chars)").select("model_id", "max_chars", "overlap_chars").head(5)
    if wrong:
        raise ValueError(f"models whose pieces cannot share so much: {[tuple(r) for r in wrong]}")
    m = models.select(F.col("model_id").alias("m_id"), F.col("max_chars").cast("bigint").alias("max_chars"), F.coalesce(F.col("overlap_chars").cast("bigint"), F.lit(0)).alias("overlap"), F.coalesce("is_default", F.lit(False)).alias("is_default"))
    m = m.where("m_id is not null and not is_default").drop("is_default").unionByName(m.where("is_default").select(F.explode(F.array("m_id", F.lit(None))).alias("m_id"), "max_chars", "overlap"))
    m = m.groupBy("m_id").agg(F.min("max_chars").alias("max_chars"), F.min("overlap").alias("overlap"))
    x = spread(df.select(df[key].alias("k"), df[model].alias("model"), df[text].alias("t")).where("t is not null"))
    x = x.join(small_side(m, MAX_MODELS), F.col("model").eqNullSafe(F.col("m_id")), "left").select("k", F.coalesce("max_chars", F.lit(0)).alias("size"), F.coalesce("overlap", F.lit(0)).alias("overlap"), "t")
    kind = x.schema["k"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            index = []
            for i, (size, overlap, t) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                spans = pieces(t, size, overlap)
                for no, (s, e) in enumerate(spans):
                    index.append(i)
                    for r, v in zip(rows, (no, len(spans), s, e, t[s:e] if with_text else None)):
                        r.append(v)
            cols = [batch.column(0).take(pa.array(index, pa.int32())), *(pa.array(r, pa.int32()) for r in rows[:4]), pa.array(rows[4], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["k", "piece_no", "n_pieces", "start_pos", "end_pos", "piece"])

    out = x.mapInArrow(cut, f"k {kind}, piece_no int, n_pieces int, start_pos int, end_pos int, piece string").withColumnRenamed("k", key)
    return out if with_text else out.drop("piece")


def coverage(df: DataFrame, models: DataFrame, key: str = "scan_id", text: str = "text", model: str = "model_id") -> DataFrame:
    """(key, n_chars, is_cut, fits, covers, overlaps, same_text) of each distinct row with a text and a known model, from its pieces.

    ``fits``: no piece is longer than the limit; ``covers``: the first begins and the last ends with the text;
    ``overlaps``: neighbours share the model's overlap and none lies inside another; ``same_text``: the pieces without
    their overlaps are the text. Rows of one key, model and text count once.
    """
    # A row is named by its text's digest, so pieces do not carry the text that they are of.
    row = F.struct(df[key].alias("k"), df[model].alias("m"), F.length(df[text]).cast("bigint").alias("n"), F.sha2(df[text], 256).alias("h"))
    x = df.where(df[text].isNotNull()).select(row.alias("row"), df[model].alias("model"), df[text].alias("t")).dropDuplicates(["row"])
    cut = split_oversized(x, models, "row", "t", "model")
    known = models.select(F.col("model_id").alias("m_id"), "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("share"), "is_default")
    cut = cut.join(small_side(known, MAX_MODELS), (F.col("row.m") == F.col("m_id")) | (F.col("row.m").isNull() & F.col("is_default")))
    # The pieces of a text are in one row after this, which is as large as the text.
    g = cut.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece"))).alias("ps"), F.first("max_chars").alias("size"), F.first("share").alias("share"))
    own = F.transform("ps", lambda p, i: F.when(i == 0, p["piece"]).otherwise(p["piece"].substr(F.col("share").cast("int") + 1, F.length(p["piece"]))))
    after = F.zip_with(F.slice("ps", F.lit(1), F.size("ps") - 1), F.slice("ps", F.lit(2), F.size("ps") - 1), lambda a, b: (b["start_pos"] == a["end_pos"] - F.col("share")) & (b["end_pos"] > a["end_pos"]) & (b["start_pos"] > a["start_pos"]))
    return g.select(
        F.col("row.k").alias(key), F.col("row.n").alias("n_chars"), (F.size("ps") > 1).alias("is_cut"), F.forall("ps", lambda p: F.length(p["piece"]) <= F.col("size")).alias("fits"),
        ((F.get("ps", F.lit(0))["start_pos"] == 0) & (F.element_at("ps", -1)["end_pos"] == F.col("row.n"))).alias("covers"), F.forall(after, lambda ok: ok).alias("overlaps"), (F.sha2(F.array_join(own, ""), 256) == F.col("row.h")).alias("same_text"),
    ).distinct()
