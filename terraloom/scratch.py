"""Written intermediate tables.

Iterative jobs cut their lineage by writing a table to the shared folder the
cluster names in ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs one stage and not the whole loop.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rows of a table whose size has been counted that may be broadcast.
BROADCAST_ROWS = 250_000
# Rows that a task sorts or gathers, about, where tables outgrow the session's
# partitions.
PART_ROWS = 500_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediates, taken from the session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-terraloom-", dir="/tmp")
        atexit.register(shutil.rmtree, _local_roots[app], True)
    return _local_roots[app]


def _folder(spark: SparkSession) -> str:
    return os.path.join(scratch_root(spark), "tables", spark.sparkContext.applicationId)


def _remove(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables once results are stored."""
    _remove(spark, _folder(spark))


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it ends: what is read after it is the
    written table. Otherwise they stay until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return the written table."""
    return cut_with(df)[0]


def cut_with(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` and return it with figures observed while writing.

    ``rows`` is always among the figures.
    """
    spark = df.sparkSession
    path = os.path.join(_folder(spark), uuid.uuid4().hex)
    seen = Observation()
    exprs = [F.count(F.lit(1)).alias("rows")] + [c.alias(n) for n, c in metrics.items()]
    with _shuffles_removed(spark):
        df.observe(seen, *exprs).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), dict(seen.get)


class Successive:
    """Tables of a loop: each is written from the one before, which then goes.

    The one before stays until the new one is complete, so a lost executor
    costs a stage and the loop holds two tables at most.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._last = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        path = os.path.join(_folder(self.spark), uuid.uuid4().hex)
        df.write.parquet(path)
        if self._last:
            _remove(self.spark, self._last)
        self._last = path
        return self.spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the counted ``rows`` stay under ``limit``.

    Above it Spark joins by shuffle, with adaptive skew splitting.
    """
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` into as many parts as its counted ``rows``
    ask for; left as it is while the session's partitions are enough."""
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
