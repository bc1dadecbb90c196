"""Sharding by jump consistent hashing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAW = "key"
SUB_BUCKETS = 1024
RUN = 65536
_C = 2862933555777941757  # the generator's multiplier in the published algorithm
_M32 = 0xFFFFFFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _times32(x: Column, k: int) -> Column:
    """x * k modulo 2**32 (and below 2**50) for x and k below 2**32."""
    return x * _long(k & 0xFFFF) + F.shiftleft((x * _long(k >> 16)).bitwiseAND(_long(0xFFFF)), 16)


def jump_hash(key: Column, shards: int) -> Column:
    """Jump consistent hash (Lamping and Veach 2014) of a 64-bit key into 0 .. shards - 1.

    The generator `key * 2862933555777941757 + 1` modulo 2**64 is kept in two 32-bit halves,
    so that nothing overflows under ANSI arithmetic. Each step raises the bucket, so `shards`
    steps are always enough; finished keys pass through unchanged.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    c_lo, c_hi = _C & _M32, _C >> 32

    def step(s: Column, _: Column) -> Column:
        lo, hi, j = s["lo"], s["hi"], s["j"]
        p0, p1 = lo * _long(c_lo & 0xFFFF), lo * _long(c_lo >> 16)
        low = p0.bitwiseAND(_long(_M32)) + F.shiftleft(p1.bitwiseAND(_long(0xFFFF)), 16) + _long(1)
        high = (F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(low, 32) + _times32(lo, c_hi) + _times32(hi, c_lo)).bitwiseAND(_long(_M32))
        # the state's top 31 bits are its high half without the last bit
        to = F.floor((j + _long(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + _long(1)).cast("double"))).cast("long")
        return F.when(j >= _long(shards), s).otherwise(F.struct(j.alias("b"), to.alias("j"), low.bitwiseAND(_long(_M32)).alias("lo"), high.alias("hi")))

    start = F.struct(_long(-1).alias("b"), _long(0).alias("j"), key.bitwiseAND(_long(_M32)).alias("lo"), F.shiftrightunsigned(key, 32).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["b"].cast("int")


def stable_key(df: DataFrame, column: str) -> Column:
    """Integers (null: 0) as they are, anything else by its 64-bit hash."""
    if df.schema[column].dataType.typeName() in ("long", "integer", "short", "byte"):
        return F.coalesce(F.col(column).cast("long"), _long(0))
    return F.xxhash64(F.col(column))


def assign(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """df with the shard of every row; rows of equal keys share a shard. No shuffle, any extra columns stay."""
    return df.withColumn(out, jump_hash(stable_key(df, key), shards))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `key`: doc_id (null: 0) and the number of shards decide alone; with one more shard a
    row stays or moves into the new one. Null text has no bytes: size 1, crc32 of nothing (0).
    Slots are gapless from 0 in each shard. They come from counts of (shard, sub-bucket of the
    row's digest), summed in order of the sub-bucket, and the place in the sub-bucket, so that
    no task sorts a shard. Equal rows are counted first and dealt out again afterwards; a key
    of many rows falls apart by text.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(data).cast("long") + _long(1)).alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
    )
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    kinds = assign(assign(kinds, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    kinds = kinds.withColumn("sub", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), _long(SUB_BUCKETS)).cast("int"))
    sums = kinds.groupBy("shard", "sub").agg(F.sum("n").alias("total"))
    before = W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    # at most shards * SUB_BUCKETS rows, whatever the input: proven small enough to broadcast
    base = sums.select(F.col("shard").alias("b_shard"), F.col("sub").alias("b_sub"), F.coalesce(F.sum("total").over(before), _long(0)).alias("base"))
    inside = W.partitionBy("shard", "sub").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        kinds.withColumn("inner", F.coalesce(F.sum("n").over(inside), _long(0)))
        .join(F.broadcast(base), (F.col("shard") == F.col("b_shard")) & (F.col("sub") == F.col("b_sub")))
        .withColumn("first", F.col("base") + F.col("inner"))
    )
    runs = placed.withColumn("run", F.explode(F.sequence(_long(0), F.floor((F.col("n") - 1) / RUN).cast("long"))))
    each = runs.withColumn("k", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("first") + F.col("k")).alias("slot"), "grown_shard")
