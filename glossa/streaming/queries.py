"""Stateless stream-static joins: each query line is answered by itself, so there is no watermark and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytestrings import prefix
from ..plans.dictionary import Dictionary


def _queries(stream: DataFrame, column: str) -> DataFrame:
    return stream.withColumn("query", F.col(column).cast("binary"))


def lookup_stream(stream: DataFrame, dictionary: Dictionary, column: str = "value") -> DataFrame:
    """The stream's columns, query and key_id (-1 for a miss)."""
    hit = dictionary.keys.select(F.col("key").alias("query"), "key_id")
    return _queries(stream, column).join(hit, "query", "left").withColumn("key_id", F.coalesce("key_id", F.lit(-1).cast("long")))


def predictive_count_stream(stream: DataFrame, dictionary: Dictionary, column: str = "value") -> DataFrame:
    """The stream's columns, query and n_found, the number of keys that start with it.

    A stateless join can't count the keys of queries beyond the locus table's prefixes: ValueError if there are such keys.
    """
    if dictionary.long_keys:
        raise ValueError("the dictionary has keys longer than its locus prefixes; count those queries in batches")
    return _queries(stream, column).join(dictionary.locus.withColumnRenamed("prefix", "query"), "query", "left").withColumn("n_found", F.coalesce(F.col("dfs_hi") - F.col("dfs_lo") + 1, F.lit(0).cast("long"))).drop("dfs_lo", "dfs_hi")


def common_prefix_stream(stream: DataFrame, dictionary: Dictionary, column: str = "value") -> DataFrame:
    """A row for every key that is a prefix of the stream's query: query, key_length, key_id, key."""
    lengths = dictionary.key_lengths
    q = _queries(stream, column)
    size = F.octet_length("query")
    at = F.sequence(F.lit(0), size) if lengths is None else F.filter(F.array(*[F.lit(n) for n in lengths or [-1]]), lambda n: (n >= 0) & (n <= size))
    pre = q.where(F.col("query").isNotNull()).withColumn("key_length", F.explode(at)).withColumn("key", prefix("query", "key_length"))
    return pre.join(dictionary.keys.select("key", "key_id"), "key")


