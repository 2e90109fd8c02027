"""Session plumbing shared by every operator: table access, shipping the package, checkpoints, spreading."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``data_dir``."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(suffix=".zip", prefix="spanloom-")  # read by the driver only, which serves it to the executors
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for base, dirs, files in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.join("spanloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a temporary one only where all runs on one machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local["):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanloom-ckpt-"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files and tables that ``df`` reads, by the optimizer's statistics; None if they are not known. Nothing is run."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except Exception:  # noqa: BLE001  # sessions without a JVM of their own
        return None
    return sum(sizes) if all(n < 1 << 60 for n in sizes) else None


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-bound stages over few input splits.

    A large input has more splits than the cluster has cores and passes unchanged, without a shuffle, as does one of
    unknown size. The splits are reckoned as the reader makes them.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores, size = spark.sparkContext.defaultParallelism, input_bytes(df)
    if size is None:
        return df
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    least = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    if math.ceil(size / min(most, max(least, size // cores))) >= cores:
        return df
    return df.repartition(cores * 2)


def bounded_collect(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a dimension table that must not exceed ``limit``; more rows are an error, never cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``limit`` rows; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
