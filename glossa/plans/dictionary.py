"""The dictionary: immutable tables with the operations of a static trie."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytestrings import display
from ..functions.config import DictConfig
from ..operators import build as _build
from ..operators import search as _search
from ..sources import storage as _storage
from .stage import release, staged

LENGTHS = 4096


@dataclass(frozen=True)
class Dictionary:
    """keys: key, weight, key_id, dfs_rank, depth. nodes: path, parent, depth, sib_rank, rank_path, subtree_weight,
    is_terminal, dfs_lo, dfs_hi. locus: prefix, dfs_lo, dfs_hi. An empty key set has the root as its only node."""

    keys: DataFrame
    nodes: DataFrame
    locus: DataFrame
    config: DictConfig
    path: str | None = None

    # -- making

    @classmethod
    def build(cls, keys: DataFrame | None, config: DictConfig | int | None = None) -> Dictionary:
        """From (key BINARY, weight); config is a DictConfig, a flag word or None. Equal keys count as one."""
        if keys is None:
            raise ValueError("dictionary is not built: no keys given")
        config = DictConfig.from_flags(config) if isinstance(config, int) else config or DictConfig()
        tables = _build.build_tables(keys, config)
        return cls(tables.keys, tables.nodes, staged(_build.locus_table(tables.nodes), "locus"), config)

    @classmethod
    def from_rows(cls, spark: SparkSession, keys: list[bytes | str | tuple[bytes | str, float]], config: DictConfig | int | None = None) -> Dictionary:
        """From Python values; for small sets and tests."""
        pairs = [k if isinstance(k, tuple) else (k, 1.0) for k in keys]
        rows = [(bytearray(k.encode() if isinstance(k, str) else k), float(w)) for k, w in pairs]
        return cls.build(spark.createDataFrame(rows, "key binary, weight double"), config)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        """From a folder that save() wrote; ValueError if its header is not one of ours."""
        keys, nodes, locus, config = _storage.load(spark, path)
        return cls(keys, nodes, locus, config, path)

    mmap = load  # tables are scanned lazily in any case

    def save(self, path: str, overwrite: bool = False) -> Dictionary:
        _storage.save(self.keys, self.nodes, self.locus, self.config, path, overwrite)
        return Dictionary.load(self.keys.sparkSession, path)

    def cache(self) -> Dictionary:
        """Keep the tables in memory; executors that are lost read them again."""
        return Dictionary(self.keys.cache(), self.nodes.cache(), self.locus.cache(), self.config, self.path)

    def clear(self) -> None:
        """Free cached tables, and delete those of a dictionary that was built and never stored. It answers no more."""
        for t in (self.keys, self.nodes, self.locus):
            t.unpersist()
        if self.path is None:
            release(self.keys, self.nodes, self.locus)

    def swap(self, other: Dictionary) -> tuple[Dictionary, Dictionary]:
        """The other and this one: `a, b = a.swap(b)`. Dictionaries don't change, so names are exchanged."""
        return other, self

    # -- querying

    @cached_property
    def long_keys(self) -> bool:
        """Whether some key is longer than the locus table's prefixes. Read once."""
        return not self.keys.where(F.octet_length("key") > _build.LOCUS).isEmpty()

    @cached_property
    def key_lengths(self) -> list[int] | None:
        """The byte lengths of keys, or None if there are more than LENGTHS of them. Read once."""
        rows = self.keys.select(F.octet_length("key").alias("n")).distinct().limit(LENGTHS + 1).collect()
        return sorted(r[0] for r in rows) if len(rows) <= LENGTHS else None

    def lookup(self, queries: DataFrame) -> DataFrame:
        return _search.lookup(queries, self.keys)

    def contains(self, queries: DataFrame) -> DataFrame:
        return _search.contained(queries, self.keys)

    def missing(self, queries: DataFrame) -> DataFrame:
        return _search.missing(queries, self.keys)

    def reverse_lookup(self, ids: DataFrame, mode: str = "left") -> DataFrame:
        return _search.reverse_lookup(ids, self.keys, mode)

    def common_prefix_search(self, queries: DataFrame, limit: int = 0, keep_missing: bool = False) -> DataFrame:
        return _search.common_prefix_search(queries, self.keys, limit, self.key_lengths, keep_missing)

    def longest_prefix(self, queries: DataFrame) -> DataFrame:
        return _search.longest_prefix(queries, self.keys, self.key_lengths)

    def predictive_search(self, queries: DataFrame, limit: int = 0, keep_missing: bool = False) -> DataFrame:
        return _search.predictive_search(queries, self.keys, self.locus, limit, keep_missing, self.long_keys)

    def predictive_count(self, queries: DataFrame) -> DataFrame:
        return _search.predictive_count(queries, self.keys, self.locus, self.long_keys)

    def starts_with(self, query: bytes) -> DataFrame:
        return _search.starts_with(self.keys, query)

    def dump(self) -> DataFrame:
        return _search.dump(self.keys)

    # -- statistics

    def size(self) -> int:
        return self.keys.count()

    num_keys = size

    def empty(self) -> bool:
        return self.keys.isEmpty()

    def num_nodes(self) -> int:
        """Nodes of the path-compressed trie, the root included."""
        return self.nodes.count()

    @property
    def num_tries(self) -> int:
        return self.config.num_tries

    @property
    def tail_mode(self) -> str:
        return self.config.tail

    @property
    def node_order(self) -> str:
        return self.config.order

    @property
    def cache_level(self) -> str:
        return self.config.cache

    def total_size(self) -> int:
        """The optimiser's estimate of the tables' bytes."""
        return sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in (self.keys, self.nodes, self.locus))

    def io_size(self) -> int:
        """Bytes of the stored files; ValueError for a dictionary that was not saved."""
        if self.path is None:
            raise ValueError("the dictionary is not stored")
        return _storage.stored_bytes(self.keys.sparkSession, self.path)

    def statistics(self) -> DataFrame:
        """One row: num_keys, num_nodes, max_depth and the configuration."""
        c = self.config
        n = self.nodes.agg(F.count(F.lit(1)).alias("num_nodes"), F.count_if("is_terminal").alias("num_keys"), F.max("depth").alias("max_depth"))
        return n.select("num_keys", "num_nodes", "max_depth", F.lit(c.num_tries).alias("num_tries"), F.lit(c.tail).alias("tail_mode"), F.lit(c.order).alias("node_order"), F.lit(c.cache).alias("cache_level"))

    def fanout(self) -> DataFrame:
        """children, n_nodes: how many nodes have how many children."""
        per = self.nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
        inner = per.groupBy("children").agg(F.count(F.lit(1)).alias("n_nodes"))
        leaves = self.nodes.join(per.select(F.col("parent").alias("path")), "path", "left_anti").agg(F.count(F.lit(1)).alias("n_nodes")).select(F.lit(0).cast("long").alias("children"), "n_nodes")
        return inner.unionByName(leaves)

    def depths(self) -> DataFrame:
        """depth, n_nodes, n_keys of every level."""
        return self.nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_terminal").alias("n_keys"))

    def create_views(self, name: str) -> None:
        """Temporary views <name>_keys, <name>_nodes and <name>_locus for SQL, with keys and paths as text too."""
        self.keys.withColumn("key_text", display("key")).createOrReplaceTempView(f"{name}_keys")
        self.nodes.withColumn("path_text", display("path")).createOrReplaceTempView(f"{name}_nodes")
        self.locus.withColumn("prefix_text", display("prefix")).createOrReplaceTempView(f"{name}_locus")
