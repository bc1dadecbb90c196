"""Intermediate tables and global ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SMALL = 2_000_000  # rows that one task ranks by itself


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder on a local master where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="glossa-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the intermediate tables if there is a block of them."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once in the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_staged", None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are staged inside are deleted at the end, but for those given to the function that this yields."""
    kept: set[str] = set()

    def keep(t: DataFrame) -> DataFrame:
        kept.add(t._staged)
        return t

    _SCOPES.append([])
    try:
        yield keep
    finally:
        for path in _SCOPES.pop():
            if path not in kept:
                _delete(spark, path)


def ranges(spark: SparkSession, rows: int) -> int:
    """How many ranges share the work on so many rows: one for few, at most spark.sql.shuffle.partitions."""
    each = max(1, SMALL // 8)
    return min(-(-rows // each) or 1, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def global_rank(df: DataFrame, order: list[Column | str], out: str, rows: int) -> DataFrame:
    """df with a dense 0-based rank by `order`, which must be unique.

    rows is the caller's count of df. Few rows are ranked by one window; more are dealt out by ranges, ranked in each
    range and shifted by the counts of the ranges before, so that no task sees the whole.
    """
    if rows <= SMALL:
        return df.withColumn(out, F.row_number().over(W.orderBy(*order)).cast("long") - 1)
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "rank")
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # one row for each range
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = ranged.withColumn(out, F.row_number().over(W.partitionBy("__range").orderBy(*order)).cast("long") - 1)
    return local.join(F.broadcast(base), F.col("__range") == F.col("__r")).withColumn(out, F.col(out) + F.col("__base")).drop("__range", "__r", "__base")


def with_next(df: DataFrame, key: str, out: str, rows: int) -> DataFrame:
    """df with the next greater value of the unique column `key` (null for the greatest)."""
    if rows <= SMALL:
        return df.withColumn(out, F.lead(key).over(W.orderBy(key)))
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(df.repartitionByRange(n, key).withColumn("__range", F.spark_partition_id()), "next")
    firsts = ranged.groupBy("__range").agg(F.min(key).alias("__first"))  # one row for each range
    after = firsts.select(F.col("__range").alias("__r"), F.lead("__first").over(W.orderBy("__range")).alias("__after"))
    local = ranged.withColumn(out, F.lead(key).over(W.partitionBy("__range").orderBy(key)))
    return local.join(F.broadcast(after), F.col("__range") == F.col("__r")).withColumn(out, F.coalesce(out, "__after")).drop("__range", "__r", "__after")
