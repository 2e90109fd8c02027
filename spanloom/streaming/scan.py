"""Scanning streams: the same narrow plan as in batch, the latest result of each document, and risk over time."""

from __future__ import annotations

import json
import os


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.plans.engine import ScanEngine


def scan_stream(stream: DataFrame, engine: ScanEngine, text: str = "text") -> DataFrame:
    """A stream of rows with results; every guard is a narrow projection, so append mode works and no state is kept."""
    return engine.policy_scan(stream, text) if engine.policy else engine.scan(stream, text)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last by ``order``; ties go to the larger row."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])


class Snapshot:
    """A folder with the latest result of each document.

    A batch adds a version of its own rows and then moves the pointer, so it costs what the batch is worth, and a repeated
    batch after a failure changes nothing twice. Readers take the last row of each document over all versions; after
    COMPACT of them they are written as one. Rows whose ``deleted`` column is true remove their document.
    """

    COMPACT = 16

    def __init__(self, path: str, key: str, order: str, deleted: str | None = None) -> None:
        self.path, self.key, self.order, self.deleted = path, key, order, deleted

    def _pointer(self, spark: SparkSession) -> dict:
        rows = spark.read.text(f"{self.path}/current").collect() if self._exists(spark, f"{self.path}/current") else []
        return json.loads(rows[0].value) if rows else {"batch": -1, "versions": []}

    @staticmethod
    def _exists(spark: SparkSession, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def _merged(self, spark: SparkSession, versions: list[str]) -> DataFrame:
        new = latest(spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{v}" for v in versions]), self.key, self.order)
        return new.where(~F.coalesce(F.col(self.deleted), F.lit(False))) if self.deleted else new

    def read(self, spark: SparkSession) -> DataFrame | None:
        versions = self._pointer(spark)["versions"]
        return self._merged(spark, versions) if versions else None

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = self._pointer(spark)
        if now["batch"] >= batch_id:
            return
        versions = [*now["versions"], f"v{batch_id}"]
        latest(batch, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/{versions[-1]}")
        if len(versions) > self.COMPACT:
            self._merged(spark, versions).write.mode("overwrite").parquet(f"{self.path}/c{batch_id}")
            versions = [f"c{batch_id}"]
        spark.createDataFrame([(json.dumps({"batch": batch_id, "versions": versions}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/current")


def keep_latest(stream: DataFrame, snapshot: Snapshot, checkpoint: str, every: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Debounced upserts: of several rows of a document in one trigger the last counts."""
    w = stream.writeStream.foreachBatch(snapshot.upsert).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def over_time(df: DataFrame, at: str, level: Column, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, level, n) by tumbling or sliding windows of event time; on a stream rows later than ``late`` are dropped."""
    x = df.withWatermark(at, late) if df.isStreaming else df
    g = x.groupBy(F.window(at, window, slide) if slide else F.window(at, window), level.alias("level")).count()
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "level", F.col("count").alias("n"))


def sessions(df: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of runs of rows of a key without a pause of ``gap``."""
    x = df.withWatermark(at, late) if df.isStreaming else df
    g = x.groupBy(key, F.session_window(at, gap)).count()
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("n"))


def checkpoint_of(path: str, name: str) -> str:
    return os.path.join(path, "_checkpoints", name)


