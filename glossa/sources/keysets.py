"""Key sets: bags of (key BINARY, weight DOUBLE) from columns and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A decimal or exponent number as written in text, or a name of infinity or NaN.
_NUMBER = r"(?i)^[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"


def _binary(c: Column) -> Column:
    return c.cast("binary")


def keyset(df: DataFrame, key: str, weight: str | float = 1.0) -> DataFrame:
    """(key, weight) of a column of text or bytes; duplicates stay, null keys go, weights are rounded to 32 bits.

    A NaN weight has no place in an order and raises when the rows are read.
    """
    w = (F.col(weight) if isinstance(weight, str) else F.lit(float(weight))).cast("float")
    w = F.when(F.isnan(w), F.raise_error(F.lit("NaN weight")).cast("double")).otherwise(F.coalesce(w, F.lit(1.0).cast("float")).cast("double"))
    return df.select(_binary(F.col(key)).alias("key"), w.alias("weight")).where(F.col("key").isNotNull())


def at(keys: DataFrame, position: str, index: int) -> DataFrame:
    """The keys at a position, by a column that the caller keeps beside them."""
    return keys.where(F.col(position) == index)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, weight) of lines `key` or `key<TAB>weight`.

    The last tab divides if a number follows it; otherwise the whole line is the key and the weight 1. One carriage
    return at the end of a line is dropped. An empty line is the empty key.
    """
    line = F.regexp_replace(F.col(column), r"\r\z", "")
    tail = F.substring_index(line, "\t", -1)
    weighted = F.contains(line, F.lit("\t")) & tail.rlike(_NUMBER)
    text = F.when(weighted, F.left(line, F.char_length(line) - F.char_length(tail) - 1)).otherwise(line)
    number = F.when(weighted, tail.try_cast("float")).otherwise(F.lit(1.0).cast("float"))
    return keyset(lines.select(text.alias("k"), number.alias("w")), "k", "w")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, weight) of text files, one key a line."""
    return parse_lines(spark.read.option("lineSep", "\n").text(paths))


def append(first: DataFrame, *more: DataFrame) -> DataFrame:
    """One bag of several."""
    for x in more:
        first = first.unionByName(x)
    return first


def tokens(df: DataFrame, column: str) -> DataFrame:
    """(key, weight 1) of the words of a text column between single spaces."""
    words = df.select(F.explode(F.split(F.col(column), " ")).alias("k")).where("k <> ''")
    return keyset(words, "k")


def statistics(keys: DataFrame) -> DataFrame:
    """num_keys (duplicates counted) and total_length in bytes of a bag."""
    return keys.agg(F.count(F.lit(1)).alias("num_keys"), F.coalesce(F.sum(F.octet_length("key").cast("long")), F.lit(0)).alias("total_length"))
