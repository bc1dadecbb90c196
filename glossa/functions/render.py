"""Text lines in the form of the command-line tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestrings import display


def lookup_lines(result: DataFrame) -> DataFrame:
    """query_id, line: `id<TAB>query`, with -1 for a miss."""
    return result.select("query_id", F.concat_ws("\t", F.col("key_id").cast("string"), display("query")).alias("line"))


def reverse_lines(result: DataFrame) -> DataFrame:
    """key_id, line: `id<TAB>key`."""
    return result.select("key_id", F.concat_ws("\t", F.col("key_id").cast("string"), display("key")).alias("line"))


def search_lines(result: DataFrame) -> DataFrame:
    """query_id, part, line of a search with keep_missing: `N found` (part -1) and `id<TAB>key<TAB>query` lines, or `not found`."""
    head = result.select("query_id", "n_found").distinct().select("query_id", F.lit(-1).alias("part"), F.when(F.col("n_found") > 0, F.concat(F.col("n_found").cast("string"), F.lit(" found"))).otherwise(F.lit("not found")).alias("line"))
    rows = result.where("n_found > 0").select("query_id", F.col("ordinal").alias("part"), F.concat_ws("\t", F.col("key_id").cast("string"), display("key"), display("query")).alias("line"))
    return head.unionByName(rows)
