"""Stored dictionaries: Parquet tables and a header, on any file system that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..functions.config import DictConfig

FORMAT, VERSION = "glossa-dictionary", 1
HEADER = "header"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save(keys: DataFrame, nodes: DataFrame, locus: DataFrame, config: DictConfig, path: str, overwrite: bool = False) -> None:
    """The header is written last, so that a save that breaks off leaves nothing that loads.

    keys are sorted by key and locus by prefix, so that scans for a literal prefix skip row groups.
    """
    spark = keys.sparkSession
    p, fs = _path(spark, path)
    if fs.exists(p):
        if not overwrite:
            raise FileExistsError(path)
        fs.delete(p, True)
    keys.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/keys")
    nodes.write.parquet(f"{path}/nodes")
    locus.repartitionByRange("prefix").sortWithinPartitions("prefix").write.parquet(f"{path}/locus")
    header = json.dumps({"format": FORMAT, "version": VERSION, **config.to_dict()})
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{path}/{HEADER}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DictConfig]:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    h, _ = _path(spark, f"{path}/{HEADER}")
    if not fs.exists(h):
        raise ValueError(f"{path} holds no dictionary")
    lines = [r[0] for r in spark.read.text(f"{path}/{HEADER}").limit(2).collect()]
    try:
        header = json.loads(lines[0]) if len(lines) == 1 else {}
    except ValueError:
        header = {}
    if not isinstance(header, dict) or header.pop("format", None) != FORMAT or header.pop("version", None) != VERSION:
        raise ValueError(f"{path} has a header of another format")
    return spark.read.parquet(f"{path}/keys"), spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/locus"), DictConfig(**header)


def stored_bytes(spark: SparkSession, path: str) -> int:
    p, fs = _path(spark, path)
    return int(fs.getContentSummary(p).getLength())
