"""Risk of a text from its guard results, as columns over one row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spans
from spanloom.plans.policy import LEVELS, RiskThresholds

TEST_PREFIX = "TEST_DATA_"
SAMPLE_CHARS = 50
ISSUE = "struct<category:string,entity_type:string,severity:string,count:int,is_test_data:boolean,sample:string>"


def level_of(score: Column, t: RiskThresholds) -> Column:
    return F.when(score >= t.critical, "critical").when(score >= t.high, "high").when(score >= t.medium, "medium").when(score >= t.low, "low").otherwise("none")


def rank_of(level: Column) -> Column:
    out = F.lit(len(LEVELS))
    for i, name in reversed(list(enumerate(LEVELS))):
        out = F.when(level == name, i).otherwise(out)
    return out


def real(detections: Column) -> Column:
    return F.filter(detections, lambda d: ~d["entity_type"].startswith(TEST_PREFIX))


def invented(detections: Column) -> Column:
    return F.filter(detections, lambda d: d["entity_type"].startswith(TEST_PREFIX))


def best_score(detections: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(detections, lambda d: d["score"])), F.lit(0.0))


def test_flags(detections: Column) -> Column:
    """Value, reason and span of each finding of invented data."""
    return F.transform(
        invented(detections),
        lambda d: F.struct(d["text"].alias("value"), F.concat(F.regexp_replace(F.lower(d["entity_type"]), "^test_data_", ""), F.lit("-pattern")).alias("reason"), d["start_pos"].alias("start_pos"), d["end_pos"].alias("end_pos")),
    )


def category_of(guard: Column) -> Column:
    return F.when(guard.isin("pii", "secret", "injection", "leakage", "testdata"), guard).otherwise(F.lit("pii"))


def issues(detections: Column, t: RiskThresholds) -> Column:
    """Real findings by guard and type: worst severity first, then more findings, then the first seen."""

    def grouped(found: Column, fake: Column) -> Column:
        def issue(k: Column, i: Column, own: Column) -> Column:
            def ranked(severity: Column) -> Column:
                return F.struct(
                    rank_of(severity).alias("r"), (-F.size(own)).alias("n"), i.alias("i"),
                    F.struct(
                        category_of(k["g"]).alias("category"), k["e"].alias("entity_type"), severity.alias("severity"), F.size(own).alias("count"),
                        F.exists(own, lambda d: F.exists(fake, lambda f: spans.overlaps(d, f))).alias("is_test_data"), F.substring(F.get(own, F.lit(0))["text"], 1, SAMPLE_CHARS).alias("sample"),
                    ).alias("issue"),
                )

            return spans.let(level_of(best_score(own), t), ranked)

        keys = F.array_distinct(F.transform(found, lambda d: F.struct(d["guard_name"].alias("g"), d["entity_type"].alias("e"))))
        each = F.transform(keys, lambda k, i: spans.let(F.filter(found, lambda d: (d["guard_name"] == k["g"]) & (d["entity_type"] == k["e"])), lambda own: issue(k, i, own)))
        return F.transform(F.array_sort(each), lambda x: x["issue"])

    # Each list is made once, however often it is looked at.
    return spans.let(detections, lambda d: spans.let(real(d), lambda found: spans.let(invented(d), lambda fake: grouped(found, fake))))


def breakdown(results: Column, t: RiskThresholds) -> Column:
    """map<guard, struct<level, score, detection_count>> of all guards but the one for invented data."""
    own = F.filter(results, lambda r: r["guard_name"] != "testdata")
    return F.map_from_entries(F.transform(own, lambda r: F.struct(r["guard_name"], F.struct(level_of(r["score"], t).alias("level"), r["score"].alias("score"), F.size(real(r["detections"])).alias("detection_count")))))


def assess(results: Column, t: RiskThresholds, strip: bool = False) -> Column:
    """struct<level, score, guards, issues, test_data_flags>; ``strip`` leaves findings that overlap invented data out of the score."""
    every = F.flatten(F.transform(results, lambda r: r["detections"]))
    counted = real(every)
    if strip:
        counted = spans.without_overlap(counted, invented(every))
    score = best_score(counted)
    return F.struct(level_of(score, t).alias("level"), score.alias("score"), breakdown(results, t).alias("guards"), issues(every, t).alias("issues"), test_flags(every).alias("test_data_flags"))


def issue_rows(detections: DataFrame, key: str, t: RiskThresholds) -> DataFrame:
    """The issues of a long table of detections: one aggregation by key, guard and type. Test overlap is left to ``assess``."""
    d = detections.where(~F.col("entity_type").startswith(TEST_PREFIX))
    g = d.groupBy(key, "guard_name", "entity_type").agg(F.max("score").alias("score"), F.count("*").alias("count"), F.min(F.struct("ord", "text"))["text"].substr(1, SAMPLE_CHARS).alias("sample"))
    return g.withColumn("severity", level_of(F.col("score"), t))
