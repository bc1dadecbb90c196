"""Batch queries against a dictionary: equi-joins on keys, ids, exploded prefixes and prefix ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytestrings import prefix, successor
from .build import LOCUS

RUN = 65_536


def as_queries(df: DataFrame, query: str, query_id: str | None = None) -> DataFrame:
    """(query_id, query BINARY); without an id column the query's text is its id."""
    q = F.col(query).cast("binary")
    return df.select((F.col(query_id) if query_id else F.col(query)).alias("query_id"), q.alias("query"))


def lookup(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """query_id, query, key_id; -1 for a query that is no key, or null."""
    hit = keys.select(F.col("key").alias("query"), "key_id")
    return queries.join(hit, "query", "left").select("query_id", "query", F.coalesce("key_id", F.lit(-1).cast("long")).alias("key_id"))


def contained(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """The queries that are keys."""
    return queries.join(keys.select(F.col("key").alias("query")), "query", "left_semi").select("query_id", "query")


def missing(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """The queries that are no keys, null queries among them."""
    return queries.join(keys.select(F.col("key").alias("query")), "query", "left_anti").select("query_id", "query")


def reverse_lookup(ids: DataFrame, keys: DataFrame, mode: str = "left") -> DataFrame:
    """ids(key_id) and any other columns, with key; ids out of range: null (left), no row (inner) or an error (strict)."""
    if mode not in ("left", "inner", "strict"):
        raise ValueError("mode must be left, inner or strict")
    out = ids.join(keys.select("key_id", "key"), "key_id", "inner" if mode == "inner" else "left")
    if mode == "strict":
        out = out.withColumn("key", F.when(F.col("key").isNull(), F.raise_error(F.concat(F.lit("key id out of range: "), F.coalesce(F.col("key_id").cast("string"), F.lit("null")))).cast("binary")).otherwise(F.col("key")))
    return out


def _prefixes(queries: DataFrame, keys: DataFrame, lengths: list[int] | None) -> DataFrame:
    """query, n, key_id, key of the keys that are prefixes of each different query."""
    size = F.octet_length("query")
    at = F.sequence(F.lit(0), size) if lengths is None else F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= size)
    pre = queries.select("query").where(F.col("query").isNotNull()).distinct().select("query", F.explode(at).alias("n")).select("query", "n", prefix("query", "n").alias("key"))
    return pre.join(keys.select("key", "key_id"), "key")


def common_prefix_search(queries: DataFrame, keys: DataFrame, limit: int = 0, lengths: list[int] | None = None, keep_missing: bool = False) -> DataFrame:
    """query_id, query, ordinal, key_id, key, n_found: keys that are prefixes of the query, shortest first.

    lengths: the byte lengths that keys have, to explode no others. limit: rows of a query, 0 for all; n_found counts
    all. keep_missing: a query without matches, a null one too, gives a row with n_found 0 and null key.
    Different queries are searched once; each row of queries is answered for itself, also if it repeats.
    A query has at most as many matches as bytes and one, so they are gathered in one row.
    """
    hits = _prefixes(queries, keys, lengths).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "key_id", "key"))).alias("m"))
    hits = queries.select("query_id", "query").join(hits, "query", "left" if keep_missing else "inner")
    some = F.slice("m", F.lit(1), F.lit(limit)) if limit else F.col("m")
    out = hits.select("query_id", "query", F.when(F.col("m").isNull(), 0).otherwise(F.size("m")).cast("long").alias("n_found"), (F.posexplode_outer if keep_missing else F.posexplode)(some).alias("pos", "x"))
    return out.select("query_id", "query", F.col("pos").cast("int").alias("ordinal"), F.col("x.key_id").alias("key_id"), F.col("x.key").alias("key"), "n_found")


def longest_prefix(queries: DataFrame, keys: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """query_id, query, key_id, key of the longest key that is a prefix of the query, for each row of queries."""
    best = _prefixes(queries, keys, lengths).groupBy("query").agg(F.max_by(F.struct("key_id", "key"), "n").alias("x"))
    return queries.select("query_id", "query").join(best, "query").select("query_id", "query", "x.key_id", "x.key")


def reach(queries: DataFrame, keys: DataFrame, locus: DataFrame, long_keys: bool = True) -> DataFrame:
    """(query, dfs_lo, dfs_hi): the locus table's prefixes of lengths that queries have, and the ranges of longer queries.

    Those meet the keys of the same first LOCUS bytes. long_keys: whether there may be keys longer than LOCUS bytes.
    The lengths are at most LOCUS + 1 rows, so that only prefixes that can be asked for are shuffled.
    """
    lengths = queries.select(F.octet_length("query").alias("__n")).where(F.col("__n") <= LOCUS).distinct()
    out = locus.join(F.broadcast(lengths), F.octet_length("prefix") == F.col("__n"), "left_semi").withColumnRenamed("prefix", "query")
    if not long_keys:
        return out
    long = queries.select("query").where(F.octet_length("query") > LOCUS).distinct().withColumn("start", prefix("query", LOCUS))
    some = keys.select("key", "dfs_rank").where(F.octet_length("key") > LOCUS).withColumn("start", prefix("key", LOCUS))
    hit = long.join(some, "start").where(F.startswith("key", "query"))
    return out.unionByName(hit.groupBy("query").agg(F.min("dfs_rank").alias("dfs_lo"), F.max("dfs_rank").alias("dfs_hi")))


def predictive_count(queries: DataFrame, keys: DataFrame, locus: DataFrame, long_keys: bool = True) -> DataFrame:
    """query_id, query, n_found for every query: the number of keys that start with it. Keys are read for long queries only."""
    out = queries.join(reach(queries, keys, locus, long_keys), "query", "left")
    return out.select("query_id", "query", F.coalesce(F.col("dfs_hi") - F.col("dfs_lo") + 1, F.lit(0).cast("long")).alias("n_found"))


def predictive_search(queries: DataFrame, keys: DataFrame, locus: DataFrame, limit: int = 0, keep_missing: bool = False, long_keys: bool = True) -> DataFrame:
    """query_id, query, ordinal, key_id, key, n_found: keys that start with the query, in pre-order.

    A prefix's keys are a range of pre-order ranks; the range is cut to `limit` (0 for all) before it is expanded, in
    runs, and joined with keys on the rank. n_found counts all. keep_missing: a query without matches, a null one too,
    gives a row with n_found 0 and null key. Each row of queries is answered for itself, also if it repeats.
    """
    ranges = reach(queries, keys, locus, long_keys)
    hit = queries.join(ranges, "query").select("query_id", "query", "dfs_lo", "dfs_hi")
    last = F.least(F.col("dfs_hi"), F.col("dfs_lo") + (limit - 1)) if limit else F.col("dfs_hi")
    runs = hit.withColumn("last", last).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(last - dfs_lo) div {RUN}"))))
    each = runs.withColumn("dfs_rank", F.explode(F.sequence(F.col("dfs_lo") + F.col("run") * RUN, F.least(F.col("last"), F.col("dfs_lo") + (F.col("run") + 1) * RUN - 1))))
    out = each.join(keys.select("dfs_rank", "key_id", "key"), "dfs_rank").select("query_id", "query", (F.col("dfs_rank") - F.col("dfs_lo")).cast("int").alias("ordinal"), "key_id", "key", (F.col("dfs_hi") - F.col("dfs_lo") + 1).alias("n_found"))
    if not keep_missing:
        return out
    none = queries.join(ranges.select("query"), "query", "left_anti")
    zero: list[Column] = [F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("long").alias("key_id"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("n_found")]
    return out.unionByName(none.select("query_id", "query", *zero))


def starts_with(keys: DataFrame, query: bytes) -> DataFrame:
    """Rows of keys whose key starts with one literal prefix: a range that file statistics can prune."""
    after = successor(query)
    out = keys.where(F.col("key") >= F.lit(bytearray(query)))
    return out if after is None else out.where(F.col("key") < F.lit(bytearray(after)))


def dump(keys: DataFrame) -> DataFrame:
    """dfs_rank, key_id, key: all keys; order by dfs_rank for the enumeration of the trie."""
    return keys.select("dfs_rank", "key_id", "key")
