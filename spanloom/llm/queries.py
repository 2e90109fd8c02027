"""The queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import chunking, credentials, mixing, overlap, pii, quality, tokens, visual
from spanloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.split_oversized(table(spark, sf_dir, "scan_requests"), table(spark, sf_dir, "bert_models"), with_text=False)
    return cut.where("piece_no = 1").select("scan_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_oversized(table(spark, sf_dir, "scan_requests"), table(spark, sf_dir, "bert_models"))


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each request and text: its length, and whether its pieces fit, begin and end where they must, and overlap as they must."""
    return chunking.coverage(table(spark, sf_dir, "scan_requests"), table(spark, sf_dir, "bert_models"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "watch_terms")
    scans = visual.find_terms(table(spark, sf_dir, "scan_requests"), terms, "scan_id", "text").select(F.lit("scan").alias("field"), F.col("scan_id").alias("row_id"), "term_id", "term", "value")
    told = visual.find_terms(table(spark, sf_dir, "detections"), terms, "detection_id", "text", whole=True).select(F.lit("detection").alias("field"), F.col("detection_id").alias("row_id"), "term_id", "term", "value")
    return scans.unionByName(told).where("value <> term").select("field", "row_id", "term_id").distinct()


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = table(spark, sf_dir, "scan_requests").select(F.struct(F.lit("scan").alias("field"), F.col("scan_id").alias("row_id")).alias("key"), "text")
    told = table(spark, sf_dir, "detections").select(F.struct(F.lit("detection").alias("field"), F.col("detection_id").alias("row_id")).alias("key"), "text")
    # One form in both tables: the classes are built over both.
    return visual.canonical_texts(scans.unionByName(told), "key", "text", table(spark, sf_dir, "watch_terms")).select("key.field", "key.row_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = overlap.near_same(table(spark, sf_dir, "ner_examples").select("example_id", "split_name", "tokens"))
    return overlap.pairs_of(members, links).select(F.least("key_e", "key_t").alias("example_id_1"), F.greatest("key_e", "key_t").alias("example_id_2")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = overlap.near_same(table(spark, sf_dir, "ner_examples").select("example_id", "split_name", "tokens", "source"))
    return overlap.report(members.distinct(), links)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = overlap.near_same(table(spark, sf_dir, "ner_examples").select("example_id", "split_name", "tokens"))
    return overlap.classes(members.distinct(), links).toDF("example_id", "split_name", "class_id", "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(table(spark, sf_dir, "scan_requests")).select("scan_id", "line_no").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(table(spark, sf_dir, "scan_requests"), redact=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(*(table(spark, sf_dir, t) for t in ("scan_requests", "detections", "given_names"))).select("scan_id", "line_no", "entity_type").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(*(table(spark, sf_dir, t) for t in ("scan_requests", "detections", "given_names")), redact=True)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total="held")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(p7_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budgets of all leaves for a mixture of all that is held, with sizes in characters instead of tokens."""
    docs = table(spark, sf_dir, "documents").where("source is not null").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    x = mixing.budgets(mixing.leaves_of(docs, table(spark, sf_dir, "mix_targets")), "held")
    return x.select("domain", "lang", "source", "size", F.round("budget", 3).alias("budget"), (F.col("budget") >= F.col("room") * (1 - 1e-9)).alias("is_full"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"), body_only=True)
    return stats.where("has_text and not is_prose").select("doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_coverage, p2_found, p2_texts, p3_found, p3_report, p3_classes, p4_found, p4_redacted, p5_found, p5_redacted, p6_ids, p7_mixture, p7_report, p7_budgets, p8_found, p8_statistics)}


def _level(name: str, children: str, totals: str) -> str:
    """CTEs that end with ``name`` (parent, child, budget) from children (parent, child, w, room) and totals (parent, total)."""
    return f"""{name}n AS ({children}), {name}t AS ({totals}), {name}x AS (SELECT * FROM {name}n JOIN {name}t USING (parent)),
            {name}u AS (SELECT a.parent, a.room / a.w AS bound, sum(least(b.room, b.w * a.room / a.w)) AS used FROM {name}x a JOIN {name}x b USING (parent) GROUP BY a.parent, a.child, a.room, a.w),
            {name}f AS (SELECT x.parent, max(u.bound) FILTER (u.used <= x.total * (1 + 1e-12)) AS bound FROM {name}x x LEFT JOIN {name}u u USING (parent) GROUP BY x.parent),
            {name}r AS (SELECT x.parent, (min(total) - coalesce(sum(room) FILTER (room / w <= bound), 0)) / nullif(sum(w) FILTER (bound IS NULL OR room / w > bound), 0) AS unit FROM {name}x x JOIN {name}f f USING (parent) GROUP BY x.parent),
            {name} AS (SELECT x.parent, x.child, CASE WHEN room / w <= bound THEN room ELSE least(room, w * unit) END AS budget FROM {name}x x JOIN {name}f f USING (parent) JOIN {name}r r USING (parent))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT DISTINCT r.scan_id FROM scan_requests r
            JOIN bert_models m ON m.model_id = r.model_id OR (r.model_id IS NULL AND m.is_default)
            WHERE length(r.text) > m.max_chars""",
        # Level by level the bound that fills the budget, found by trying each child's own: what a child takes up to a
        # bound is the lesser of its room and its weight times the bound.
        "p7_budgets": f"""
            WITH s AS (SELECT lang, source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents WHERE source IS NOT NULL GROUP BY lang, source),
            l AS (SELECT split_part(source, '-', 1) AS domain, lang, coalesce('=' || lang, 'null') AS lk, source, size, target_share * size / sum(size) OVER (PARTITION BY source) AS w, (size * max_repeats)::DOUBLE AS room
                  FROM s JOIN mix_targets USING (source) WHERE size > 0 AND target_share > 0 AND max_repeats > 0),
            {_level("top", "SELECT domain AS child, 0 AS parent, sum(w) AS w, sum(room) AS room FROM l GROUP BY domain", "SELECT 0 AS parent, sum(size)::DOUBLE AS total FROM l")},
            {_level("mid", "SELECT lk AS child, domain AS parent, sum(w) AS w, sum(room) AS room FROM l GROUP BY lk, domain", "SELECT child AS parent, budget AS total FROM top")},
            {_level("low", "SELECT source AS child, domain || '|' || lk AS parent, w, room FROM l", "SELECT parent || '|' || child AS parent, budget AS total FROM mid")}
            SELECT l.domain, l.lang, l.source, l.size, round(low.budget, 3) AS budget, low.budget >= l.room * (1 - 1e-9) AS is_full FROM l JOIN low ON low.child = l.source AND low.parent = l.domain || '|' || l.lk""",
        # What must hold of the pieces, whatever they are.
        "p1_coverage": """
            SELECT DISTINCT r.scan_id, length(r.text) AS n_chars, length(r.text) > m.max_chars AS is_cut, true AS fits, true AS covers, true AS overlaps, true AS same_text FROM scan_requests r
            JOIN bert_models m ON m.model_id = r.model_id OR (r.model_id IS NULL AND m.is_default) WHERE r.text IS NOT NULL""",
    }
