"""How well reported spans agree with known ones, and label counts of annotated data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def span_scores(predicted: DataFrame, known: DataFrame, keys: list[str], kind: str = "entity_type") -> DataFrame:
    """(kind, tp, fp, fn, precision, recall, f1) over distinct spans given by ``keys`` and ``kind``."""
    p = predicted.select(*keys, kind).distinct().withColumn("p", F.lit(1))
    k = known.select(*keys, kind).distinct().withColumn("k", F.lit(1))
    both = p.join(k, [*keys, kind], "full")
    g = both.groupBy(kind).agg(F.count(F.when(F.col("p").isNotNull() & F.col("k").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("k").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    precision, recall = (F.when(F.col("tp") + F.col(c) > 0, F.col("tp") / (F.col("tp") + F.col(c))).otherwise(F.lit(0.0)) for c in ("fp", "fn"))
    g = g.withColumn("precision", precision).withColumn("recall", recall)
    return g.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))


def label_counts(examples: DataFrame, labels: DataFrame, split: str = "split_name", tags: str = "ner_tags") -> DataFrame:
    """(split, label, n): how often each label stands in each split; tags without label count under null."""
    t = examples.select(split, F.explode(tags).alias("tag_id")).groupBy(split, "tag_id").agg(F.count("*").alias("n"))
    return t.join(labels.select("tag_id", "label"), "tag_id", "left").groupBy(split, "label").agg(F.sum("n").alias("n"))


def align(start: int, end: int, offsets: list[tuple[int, int]]) -> list[int]:
    """Indexes of the tokens that overlap a span."""
    return [i for i, (a, b) in enumerate(offsets) if a < end and b > start]


def aligned(start: Column, end: Column, tokens: Column) -> Column:
    """The same as a column: indexes of the tokens (structs of start_pos and end_pos) that overlap a span."""
    return F.filter(F.transform(tokens, lambda t, i: F.when((t["start_pos"] < end) & (t["end_pos"] > start), i)), lambda i: i.isNotNull())


def split_by_hash(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """``df`` with a column ``split``: the same rows in the same split on any cluster, by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    out, total, upto = F.lit(None).cast("string"), sum(shares.values()), 0.0
    edges = []
    for name, share in shares.items():
        upto += share / total
        edges.append((name, upto))
    for name, edge in reversed(edges):
        out = F.when(u < edge, name).otherwise(out)
    return df.withColumn("split", F.coalesce(out, F.lit(edges[-1][0])))
