"""Relational construction of a path-compressed trie and of the ids it defines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bytestrings import common_prefix, empty, prefix
from ..functions.config import DictConfig
from ..plans.stage import global_rank, intermediate, ranges, staged, with_next
from . import walk

LOCUS = 256  # bytes of the longest prefixes that the locus table holds
BATCH = "8MB"  # of an Arrow batch: keys may be long


@dataclass(frozen=True)
class Tables:
    keys: DataFrame  # key, weight, key_id, dfs_rank, depth
    nodes: DataFrame  # path, parent, depth, sib_rank, rank_path, subtree_weight, is_terminal, dfs_lo, dfs_hi


def distinct_keys(keys: DataFrame) -> DataFrame:
    """One row a key; weights are added in double precision."""
    return keys.groupBy("key").agg(F.sum("weight").alias("weight"))


def branch_nodes(distinct: DataFrame, rows: int) -> DataFrame:
    """(path, weight) of the trie's nodes: the root, every key, and every prefix where two keys part; weight is null but for keys.

    In the order of keys, those prefixes are the common prefixes of neighbours, so one sorted pass finds them.
    """
    pair = with_next(distinct.select("key"), "key", "next", rows).where(F.col("next").isNotNull())
    none = F.lit(None).cast("double").alias("weight")
    fork = pair.select(prefix("key", common_prefix(F.col("key"), F.col("next"))).alias("path"), none)
    root = distinct.sparkSession.range(1).select(empty().alias("path"), none)
    return distinct.select(F.col("key").alias("path"), "weight").unionByName(fork).unionByName(root).groupBy("path").agg(F.max("weight").alias("weight"))


def build_tables(keys: DataFrame, config: DictConfig) -> Tables:
    """keys(key, weight) to the dictionary's tables; what is written on the way is deleted.

    Siblings are ordered by the 32-bit sum of weights below them, heaviest first, then by label (order weight), or by
    label alone (order label). key_id is the rank of the key's node in breadth-first order among nodes that are keys,
    dfs_rank the rank in pre-order. rank_path holds the two-digit hexadecimal sibling ranks from the root: pre-order is
    its order, breadth-first its order by length first.

    Nodes are sorted by path in ranges. One pass over each range gives parents and sums, a second one, once siblings are
    ranked, the places in pre-order; a node is a row in each step, whatever its depth and its path's length (see walk).
    """
    spark = keys.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    with intermediate(spark) as keep:
        distinct = staged(distinct_keys(keys), "keys")
        rows, total = distinct.agg(F.count(F.lit(1)), F.sum("weight")).first()
        n = ranges(spark, rows)
        paths = branch_nodes(distinct, rows).repartitionByRange(n, "path").sortWithinPartitions("path")
        sums = staged(paths.withColumn("range", F.spark_partition_id()).mapInArrow(walk.sums, walk.SUMS), "sums")
        loose = (F.col("state") != walk.CLOSED) | F.col("parent").isNull()
        edge = F.when((F.col("m") < 0) | (F.col("state") == walk.LAST), F.col("path")).alias("edge")
        bones = sums.where(loose).select("id", "n", "m", "w", "cnt", "state", edge).repartition(1).sortWithinPartitions("id")
        bones = staged(bones.mapInArrow(walk.skeleton, walk.SKELETON).withColumn("bone", F.lit(True)), "skeleton")

        terminal = sums.where(loose).select("id", F.col("weight").isNotNull().alias("terminal"))
        some = ["id", "m", "parent", "w", "cnt", "bone", "terminal"]
        all_ = sums.where(~loose).select("id", "m", "parent", "w", "cnt", F.lit(False).alias("bone"), F.col("weight").isNotNull().alias("terminal"))
        all_ = all_.unionByName(bones.join(terminal, "id").select(*some)).withColumn("w", F.col("w").cast("float"))
        first = [F.desc("w")] if config.order == "weight" else []
        sib = W.partitionBy("parent").orderBy(*first, "id")
        earlier = F.coalesce(F.sum("cnt").over(sib.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier")
        ranked = staged(all_.select(*some, (F.row_number().over(sib) - 1).alias("sib_rank"), earlier), "siblings")

        node = ranked.select("id", "m", "parent", "w", "cnt", "terminal", "sib_rank", "earlier", F.lit(None).cast("string").alias("rank_path"), F.lit(None).cast("long").alias("dfs_lo"))
        known = node.where(ranked["bone"]).repartition(1).sortWithinPartitions("id").mapInArrow(walk.places, walk.PLACES)
        known = staged(known.select("id", "rank_path", F.coalesce("dfs_lo", F.lit(0)).alias("dfs_lo")), "skeleton-places")
        both = node.unionByName(known, allowMissingColumns=True)
        both = both.repartitionById(n, F.shiftright("id", walk.SHIFT).cast("int")).sortWithinPartitions("id", F.col("m").asc_nulls_first())
        places = both.mapInArrow(walk.places, walk.PLACES)
        nodes = staged(sums.select("id", "path", "weight").join(places, "id"), "nodes")

        out_keys = nodes.where("weight is not null").select(F.col("path").alias("key"), "weight", F.col("dfs_lo").alias("dfs_rank"), "depth")
        out_keys = global_rank(out_keys, ["depth", "dfs_rank"], "key_id", rows).select("key", "weight", "key_id", "dfs_rank", "depth")
        out_keys = keep(staged(out_keys, "dictionary-keys"))
        at_root = F.octet_length("path") == 0
        out_nodes = nodes.select(
            "path",
            F.when(~at_root, prefix("path", "m")).alias("parent"),
            "depth",
            "sib_rank",
            "rank_path",
            F.when(at_root, F.lit(total).cast("float")).otherwise(F.col("w")).alias("subtree_weight"),
            F.col("weight").isNotNull().alias("is_terminal"),
            "dfs_lo",
            "dfs_hi",
        )
        return Tables(out_keys, keep(staged(out_nodes, "dictionary-nodes")))


def locus_table(nodes: DataFrame) -> DataFrame:
    """(prefix, dfs_lo, dfs_hi): every prefix of a key of up to LOCUS bytes with the range of ranks of the keys below.

    A prefix that ends within an edge has the range of the node the edge leads to. Longer prefixes are few in use and
    costly to keep, as their bytes grow with the square of a key's; searches find them by the keys (see ranges).
    """
    from_ = F.coalesce(F.octet_length("parent") + 1, F.lit(0))
    to = F.least(F.octet_length("path"), F.lit(LOCUS))
    some = nodes.where("dfs_lo is not null").where(from_ <= LOCUS)
    return some.select(F.explode(F.sequence(from_, to)).alias("n"), "path", "dfs_lo", "dfs_hi").select(prefix("path", "n").alias("prefix"), "dfs_lo", "dfs_hi")
