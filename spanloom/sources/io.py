"""Where texts come from and results go: files of the usual formats, JSON requests, and size limits."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BODY_BYTES = 1 << 20
REQUEST = "text string, config struct<guards:map<string,struct<enabled:boolean,threshold:double,mode:string>>>"


def read_texts(spark: SparkSession, path: str, kind: str = "parquet", text: str = "text", key: str | None = None, **options) -> DataFrame:
    """(key, text) from parquet, json, csv, orc or text files; whole files with ``kind`` "files". Without a key rows get one of their own."""
    if kind == "files":
        df = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("text"))
        return df
    df = spark.read.format(kind).options(**options).load(path)
    source = F.col("value" if kind == "text" else text)
    return df.select((F.col(key) if key else F.monotonically_increasing_id()).alias("key"), source.alias("text"))


def stream_texts(spark: SparkSession, path: str, schema: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies as columns: text, config, and ``error`` where the text is missing, the body no JSON or too large."""
    x = bodies.withColumn("_r", F.from_json(body, REQUEST))
    error = F.when(F.octet_length(body) > MAX_BODY_BYTES, "body too large").when(F.col("_r").isNull(), "invalid JSON").when(F.col("_r.text").isNull(), "text is required")
    return x.select(*bodies.columns, F.col("_r.text").alias("text"), F.col("_r.config").alias("config"), error.alias("error"))


def within(text: Column, limit: int = MAX_BODY_BYTES) -> Column:
    return F.octet_length(text) <= limit


def unpivot(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text) of several text columns, without a shuffle."""
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f")).select(key, "f.field", "f.text")


def write_results(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.format(kind).mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def to_json(df: DataFrame, out: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


@dataclass(frozen=True)
class Settings:
    """Settings from the environment, with fallbacks; a number that is none falls back too."""

    policy: str = "moderate"
    threshold: float = 0.5
    max_body_bytes: int = MAX_BODY_BYTES
    reviewer: str = "none"

    @staticmethod
    def from_environment(env: dict[str, str] | None = None, prefix: str = "SPANLOOM_") -> Settings:
        env, base = os.environ if env is None else env, Settings()

        def number(name: str, kind: type, fallback):
            try:
                return kind(env.get(prefix + name, fallback))
            except ValueError:
                return fallback

        return Settings(env.get(prefix + "POLICY", base.policy), number("THRESHOLD", float, base.threshold), number("MAX_BODY_BYTES", int, base.max_body_bytes), env.get(prefix + "REVIEWER", base.reviewer))
