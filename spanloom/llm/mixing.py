"""Mixing sources to target weights by hierarchical budgets.

Weights stand on the leaves of a tree domain -> language -> source. A total is handed down by weight; what a node cannot
use, because its documents repeated as often as allowed are fewer, goes to its siblings first and to its ancestors' other
children only when all siblings are full. Each leaf then takes whole seeded epochs and a prefix of the next one. All of it
is done on tables, so leaves and targets may be as many as they like.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import bpe, tokens
from spanloom.runtime import materialize, small_side

#: Leaves that are broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 100_000
#: Documents of a leaf that share a bucket of the epoch's order, on average.
BUCKET_ROWS = 5_000
#: Copies of one row that are told apart at once.
COPIES_AT_ONCE = 1_000


def _filled(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (the parent's columns and its ``total``, child, weight, room) with ``budget``: by weight, up to their rooms.

    In the order of room by weight the full ones come first: a node is full if its part of what those before it have left
    over is no less than its room. All others share the rest by weight.
    """
    w = Window.partitionBy(*parent)
    order = w.orderBy(F.col("room") / F.col("weight"), "child").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    x = nodes.withColumns({"_rooms": before("room"), "_weights": F.sum("weight").over(w) - before("weight")})
    x = x.withColumn("_full", F.col("room") * F.col("_weights") <= F.col("weight") * (F.col("total") - F.col("_rooms")) * (1 + 1e-12))
    x = x.withColumn("_rest", F.greatest(F.lit(0.0), F.col("total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("room"))).over(w), F.lit(0.0))))
    x = x.withColumn("budget", F.when(F.col("_full"), F.col("room")).otherwise(F.col("weight") * F.col("_rest") / F.sum(F.when(~F.col("_full"), F.col("weight"))).over(w)))
    return x.drop("_rooms", "_weights", "_full", "_rest", "total")


def budgets(leaves: DataFrame, total: float | Literal["held"] | None) -> DataFrame:
    """``leaves`` (domain, lang, source, size, weight, room) with ``budget``: by weight, shortages to siblings before ancestors.

    ``total`` "held" is the sum of the leaves' sizes; None is the largest at which every leaf reaches its weight's share.
    Budgets add up to less than the total only if all leaves are full. Leaves without weight or room get none.
    """
    x = leaves.where("weight > 0 and room > 0").withColumn("lang_key", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")))
    every = Window.partitionBy()
    sums = (F.sum("weight").alias("weight"), F.sum("room").alias("room"))
    top = x.groupBy("domain").agg(*sums, F.sum("size").cast("double").alias("size"), F.min(F.col("room") / F.col("weight")).alias("least"))
    whole = {"held": F.sum("size").over(every), None: F.min("least").over(every) * F.sum("weight").over(every)}
    top = _filled(top.withColumn("total", whole[total] if total in whole else F.lit(float(total))).withColumn("child", F.col("domain")), [])
    middle = x.groupBy("domain", "lang_key").agg(*sums).join(top.select("domain", F.col("budget").alias("total")), "domain")
    middle = _filled(middle.withColumn("child", F.col("lang_key")), ["domain"])
    low = x.join(middle.select("domain", "lang_key", F.col("budget").alias("total")), ["domain", "lang_key"])
    return _filled(low.withColumn("child", F.col("source")), ["domain", "lang_key"]).drop("child", "lang_key")


def leaves_of(stats: DataFrame, targets: DataFrame) -> DataFrame:
    """(domain, lang, source, n, size, weight, room) from (lang, source, n, size): a source's weight is shared by its sizes.

    Of several targets of one source the largest counts.
    """
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    x = stats.where("size > 0").join(t, "source")
    share = F.col("target_share") * F.col("size") / F.sum("size").over(Window.partitionBy("source"))
    return x.select(F.split_part("source", F.lit("-"), F.lit(1)).alias("domain"), "lang", "source", "n", "size", share.alias("weight"), (F.col("size") * F.col("max_repeats")).cast("double").alias("room"))


def _same_leaf(lang: str, source: str) -> Column:
    return F.col("lang").eqNullSafe(F.col(lang)) & (F.col("source") == F.col(source))


def mixture(
    documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    total: float | Literal["held"] | None = None, seed: int = 17, vocabulary: str = bpe.DEFAULT_VOCABULARY,
) -> DataFrame:
    """(key, domain, lang, source, n_tokens, copies): each chosen document and how often it occurs.

    ``targets`` has source, target_share and max_repeats. ``total`` is the size in tokens; "held" is that of all documents
    of sources with a target, where short sources stop at their repeats and others fill in; None is the largest at which
    every source reaches its share. A source's domain is its name before the first hyphen. Inside a source languages keep
    their own proportions; a null language is a leaf of its own. A source's share is met to half a document a leaf.

    Rows with a null source, or of a source without target, are not chosen; a target without documents gets nothing and
    its share goes to the others. Null and empty texts have no size and are chosen with the epoch's prefix around them.
    Repeated rows count as documents of their own, also those with a null key. With no documents or no targets the result
    is empty.
    """
    d = documents.select(documents[key].alias("k"), documents[lang].alias("lang"), documents[source].alias("source"), documents[text].alias("text")).where("source is not null")
    d = d.withColumn("c", F.xxhash64("text"))  # rows of one key, or of none, stand apart by their texts
    d = materialize(tokens.with_token_counts(d, vocabulary=vocabulary))
    stats = d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("size"))
    plan = budgets(leaves_of(stats, targets), total).where("budget > 0")
    epochs = F.floor(F.col("budget") / F.col("size") + F.lit(1e-9))
    plan = plan.select(F.col("lang").alias("p_lang"), F.col("source").alias("p_source"), "domain", epochs.alias("epochs"), (F.col("budget") - epochs * F.col("size")).alias("rest"), F.greatest(F.lit(1), F.floor(F.col("n") / BUCKET_ROWS)).alias("buckets"))
    plan = materialize(plan)  # a row for each leaf
    x = d.join(small_side(plan, BROADCAST_LEAVES), _same_leaf("p_lang", "p_source")).drop("p_lang", "p_source")
    x = x.withColumn("h", F.xxhash64(F.lit(seed), F.col("epochs") + 1, "k", "c"))
    x = x.withColumn("bucket", F.floor(F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("buckets")))
    # Only sizes of buckets are put in order by leaf; documents are ordered inside the one bucket where the leaf's budget ends.
    sizes = x.groupBy("lang", "source", "rest", "bucket").agg(F.sum("n_tokens").alias("size"))
    earlier = lambda *order: Window.partitionBy("lang", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier("bucket")), F.lit(0))).where("before < rest")
        .groupBy(F.col("lang").alias("e_lang"), F.col("source").alias("e_source")).agg(F.max("bucket").alias("edge"), F.max_by("before", "bucket").alias("before"))
    )
    x = x.join(small_side(edge, BROADCAST_LEAVES), _same_leaf("e_lang", "e_source"), "left").drop("e_lang", "e_source")
    out = ["k", "domain", "lang", "source", "n_tokens", "copies"]
    others = x.where("edge is null or bucket <> edge").withColumn("copies", F.col("epochs") + F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)))
    # Repeated rows are one row with a count until it is known how many of them the budget takes.
    g = x.where("bucket = edge").groupBy("lang", "source", "domain", "h", "k", "c", "n_tokens", "epochs", "rest", "before").agg(F.count("*").alias("m"))
    at = F.col("before") + F.coalesce(F.sum(F.col("n_tokens") * F.col("m")).over(earlier("h", "k", "c")), F.lit(0))
    fitting = F.when(F.col("n_tokens") > 0, F.floor((F.col("rest") - at) / F.col("n_tokens") + F.lit(0.5))).otherwise(F.when(at <= F.col("rest"), F.col("m")).otherwise(0))
    g = g.withColumn("taken", F.least(F.col("m"), F.greatest(F.lit(0), fitting)).cast("bigint"))
    g = g.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / COPIES_AT_ONCE))))
    g = g.withColumn("j", F.explode(F.sequence(F.col("block") * COPIES_AT_ONCE, F.least(F.col("m"), (F.col("block") + 1) * COPIES_AT_ONCE) - 1)))
    at_edge = g.withColumn("copies", F.col("epochs") + (F.col("j") < F.col("taken")).cast("int"))
    return at_edge.select(*out).unionByName(others.select(*out)).where("copies > 0").withColumnRenamed("k", key)


def report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, most_copies, actual_share) of each target."""
    got = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    x = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["documents", "tokens", "most_copies"])
    # A row for each target: the window over all of them is small.
    return x.withColumn("actual_share", F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), F.lit(0.0)))
