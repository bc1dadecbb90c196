"""Shared folder handling and vectorised text kernels of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[int, list[str]] = {}
_KEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one on a local master where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix="glossa-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


BATCH = "8m"
#: Frees the shuffle files of a query when it has ended.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    What df's own query has shuffled is deleted when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    _WRITTEN.setdefault(id(spark), []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to BATCH: texts of a batch are held several times over in a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        _delete(spark, t._written)
        _WRITTEN[id(spark)].remove(t._written)
        _KEPT.discard(t._written)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end, but for those given to keep()."""
    before = set(_WRITTEN.setdefault(id(spark), []))
    yield
    for path in [p for p in _WRITTEN[id(spark)] if p not in before and p not in _KEPT]:
        _delete(spark, path)
        _WRITTEN[id(spark)].remove(path)


def keep(written: DataFrame) -> DataFrame:
    """A table that materialize() wrote outlives the block of temporaries() around it, until discard() or cleanup()."""
    _KEPT.add(written._written)
    return written


def cleanup(spark: SparkSession) -> None:
    """Delete every table that materialize() wrote in this session. Results that still read them end."""
    for path in _WRITTEN.pop(id(spark), []):
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name like `name` that is no column of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- byte and word kernels

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW = {"b": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}
SLICE = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd base and of its inverse."""
    if len(_POW["b"]) < n:
        for k, v in (("b", _BASE), ("i", _INV)):
            a = np.full(n, v, np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW["b"][:n], _POW["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """p with p[e] - p[s] times the inverse base to the s = polynomial hash of buf[s:e]."""
    b, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * b[: len(buf)], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(p))
    return mix((p[end] - p[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a few documents: hash, document number, byte place in the joined buffer."""

    __slots__ = ("buf", "start", "end", "hash", "doc", "first", "at")

    def __init__(self, texts: list[bytes], lower: bool = True):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.at = np.concatenate(([0], np.cumsum(lens)))  # document i holds bytes at[i] .. at[i + 1] - 1
        self.buf = LOWER[raw] if lower else raw
        gap = SPACE[self.buf]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = span_hash(prefix_hash(self.buf), self.start, self.end)
        self.first = np.searchsorted(self.start, self.at)  # words of document i: first[i] .. first[i + 1] - 1
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def rows_of(batch, step: int = 256) -> Iterator[tuple]:
    """Rows of an Arrow batch as Python tuples, converted a few at a time."""
    for lo in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(lo, step).columns))


def slices(rows: Iterable[tuple], text_at: int, limit: int = SLICE) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Rows and their encoded texts (null: empty) in runs of about `limit` bytes; a row is never cut."""
    part, texts, size = [], [], 0
    for row in rows:
        b = (row[text_at] or "").encode("utf-8", "surrogatepass")
        part.append(row)
        texts.append(b)
        size += len(b)
        if size >= limit:
            yield part, texts
            part, texts, size = [], [], 0
    if part:
        yield part, texts


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of n words; a document with fewer (at least one) words gives one run of all."""
    mult = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    m = len(w.hash)
    if m >= n:
        h = np.zeros(m - n + 1, np.uint64)
        for k in range(n):
            h += w.hash[k : m - n + 1 + k] * mult[k]
        ok = w.doc[: m - n + 1] == w.doc[n - 1 :]
        h, d = mix(h[ok]), w.doc[: m - n + 1][ok]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        more = np.zeros(len(short), np.uint64)
        for j, i in enumerate(short):
            own = w.hash[w.first[i] : w.first[i + 1]]
            more[j] = np.sum(np.append(own * mult[: len(own)], mult[len(own)]))
        h, d = np.concatenate((h, mix(more))), np.concatenate((d, short))
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and digest of a set of edges; stars that a round leaves unchanged are final."""
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0))).first()
    return int(r[0]), int(r[1])


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component) of every vertex of edges(a, b), written: the least id that is reachable.

    Alternating large-star and small-star steps (each halves the depth of trees),
    written after each round; a hub's edges are combined before they are shuffled.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    mark = _mark(e)
    while mark[0]:
        # large star: every neighbour above u gets the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lesser neighbours get the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, e = e, materialize(small, name)
        discard(last)
        if (new := _mark(e)) == mark:
            break
        mark = new
    ends = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")))
    out = materialize(ends.groupBy("id").agg(F.min("component").alias("component")), name)
    discard(e)
    return out
