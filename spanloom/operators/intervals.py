"""Overlaps between spans of two tables. Places are cut into stretches, so a text with very many spans is many keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCH = 2_000


def _stretched(df: DataFrame, prefix: str) -> DataFrame:
    """Each span once for each stretch that it touches; a span that is empty or turned around touches none."""
    first, last = F.floor(F.col("start_pos") / STRETCH), F.floor((F.col("end_pos") - 1) / STRETCH)
    x = df.where("start_pos < end_pos").withColumns({"_first": first, "_stretch": F.explode(F.sequence(first, last))})
    return x.select(*[F.col(c).alias(f"{prefix}_{c.lstrip('_')}") for c in x.columns])


def overlapping(a: DataFrame, b: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """Pairs of spans of one key that overlap, once each: the columns of ``a`` as a_*, of ``b`` as b_*.

    Both have the key, start_pos and end_pos (half-open). A pair is taken in the first stretch that both touch.
    """
    x, y = _stretched(a, "a"), _stretched(b, "b")
    on = (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("a_stretch") == F.col("b_stretch")) & (F.col("a_start_pos") < F.col("b_end_pos")) & (F.col("a_end_pos") > F.col("b_start_pos"))
    on = on & (F.col("a_stretch") == F.greatest("a_first", "b_first"))
    return x.join(y, on if where is None else on & where).drop("a_first", "b_first", "a_stretch", "b_stretch")


def without_overlap(a: DataFrame, b: DataFrame, key: str, id_: str) -> DataFrame:
    """The rows of ``a`` whose span overlaps none of ``b`` of the same key; ``id_`` tells the rows of ``a`` apart."""
    met = overlapping(a.select(id_, key, "start_pos", "end_pos"), b.select(key, "start_pos", "end_pos"), key).select(F.col(f"a_{id_}").alias("_met"), F.col("a_start_pos").alias("_s"), F.col("a_end_pos").alias("_e")).distinct()
    return a.join(met, (F.col(id_) == F.col("_met")) & (F.col("start_pos") == F.col("_s")) & (F.col("end_pos") == F.col("_e")), "left_anti")
