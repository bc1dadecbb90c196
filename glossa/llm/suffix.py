"""Removal of repeated substrings with suffix arrays built by external induced sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix, prefix_hash, rows_of, slices, small_batches, span_hash
from .induced import Scratch, Spool, suffix_order

LENGTH = 200  # bytes of a repeated string
GRAM = 40  # bytes of an anchor; every window of LENGTH bytes has one
SIDES = 2  # anchors are told apart by where in the window they lie
SHARD = 1 << 20  # bytes that are sorted together
LIMIT = 1 << 17  # entries of a queue or a sequence that a sort holds in memory, the others are on disk
HOT = SHARD // (2 * LENGTH)  # keys of more different contents are split into their windows

_RUNS = "rid long, did long, lo int, hi int, key long, content long, check long"
_HITS = "key long, content long, check long, x int, y int"


# ---------------------------------------------------------------- one shard


def repeats(rows: Iterable[tuple[list[tuple[int, ...]], list[bytes]]], limit: int | None = None, scratch: Scratch | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tags, first, end) of the runs of windows of LENGTH bytes that occur again among all segments.

    rows gives tags and segments, a few at a time; they are written to scratch files, so any number fits.
    """
    limit, own = limit or LIMIT, scratch or Scratch()
    text, tags, n, width = own.file(), own.file(), 0, 0
    for tag, segments in rows:
        for x, segment in zip(tag, segments):
            text.write(_coded(segment))
            tags.write(np.array((*x, n), np.int64).tobytes())
            width, n = len(x) + 1, n + len(segment) + 1
    if not n:
        return
    text.write(np.zeros(1, np.uint16).tobytes())
    text.flush()
    tags.flush()
    own.place = np.int32 if n < 2**31 - 1 else np.int64
    t = np.memmap(text, np.uint16, "r")
    named = np.memmap(tags, np.int64, "r").reshape(-1, width)
    hit, last = own.array(len(t), np.bool_), np.zeros(0, np.int64)
    for suffix, lcp in suffix_order(t, 258, LENGTH, own, limit).up():
        same = np.flatnonzero(lcp >= LENGTH)
        hit[suffix[same]] = True
        hit[np.append(last, suffix)[same + len(last) - 1]] = True
        last = suffix[-1:]
    for lo in range(0, len(named), 4096):
        part = np.asarray(named[lo : lo + 4096])
        start = part[:, -1]
        end = np.append(start[1:], named[lo + 4096, -1] if lo + 4096 < len(named) else len(t) - 1)
        size = end - start  # with the mark after it
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        found = np.asarray(hit[start[0] : end[-1]]) & (at < np.repeat(size - LENGTH, size))
        edge = np.flatnonzero(np.diff(found.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        of = np.searchsorted(start - start[0], edge[::2], "right") - 1
        yield part[of, :-1], edge[::2] - (start[of] - start[0]), edge[1::2] - (start[of] - start[0])


def _coded(segment: bytes) -> bytes:
    """Bytes as 16-bit symbols from 2 on, with the mark 1 after the last."""
    out = np.empty(len(segment) + 1, np.uint16)
    out[:-1] = np.frombuffer(segment, np.uint8)
    out[:-1] += 2
    out[-1] = 1
    return out.tobytes()


# ---------------------------------------------------------------- distribution


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _anchors(texts: list[bytes], sides: int = SIDES) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor and a side: document, first window, window after the last, key, content, check.

    The anchor of a window is the first of its GRAM-byte strings of least hash. All windows of a run contain the
    run's core, of which the key is the hash; equal windows lie in runs of equal keys. content and check are 128 bits
    that stand for the bytes of a run and the anchor's place in it. With as many sides as places, a run is one window.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    if len(buf) < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z, first
    p = prefix_hash(buf)
    at = np.arange(len(buf) - GRAM + 1)
    bits = np.uint64(max(1, int(len(buf)).bit_length()))
    m = (span_hash(p, at, at + GRAM) >> bits << bits) | at.astype(np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    anchor = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    s = np.arange(len(anchor))
    doc = np.searchsorted(first, s, "right") - 1
    ok = first[doc + 1] >= s + LENGTH
    step = -(-width // sides)
    side = (anchor - s) // step
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (side[1:] != side[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1])
    edge = np.append(np.flatnonzero(new), len(s))
    lo, hi = edge[:-1], edge[1:]
    lo, hi = lo[ok[lo]], hi[ok[lo]]
    core = anchor[lo] - side[lo] * step
    key = span_hash(p, core, core + LENGTH + 1 - step) + side[lo].astype(np.uint64)
    shift = (anchor[lo] - lo).astype(np.uint64) << np.uint64(32)
    content = span_hash(p, lo, hi - 1 + LENGTH) ^ shift
    check = span_hash(prefix_hash(_BYTE[buf]), lo, hi - 1 + LENGTH) ^ shift
    return doc[lo], lo, hi, key.view(np.int64), content.view(np.int64), check.view(np.int64), first


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(rows_of(batch), 2):
            doc, lo, hi, key, content, check, first = _anchors(texts)
            if len(doc):
                rid, did = pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())
                cols = [pa.array((lo - first[doc]).astype(np.int32)), pa.array((hi - first[doc]).astype(np.int32)), pa.array(key), pa.array(content), pa.array(check)]
                yield pa.RecordBatch.from_arrays([rid.take(pa.array(doc)), did.take(pa.array(doc)), *cols], names=[x.split()[0] for x in _RUNS.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, list of (key, content, check, lo, hi, hot)) to (key, content, check, hot, segment)."""
    names = ["key", "content", "check", "hot"]
    for batch in batches:
        for t, wanted in zip(batch.column(0), batch.column(1)):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            v = wanted.values
            lo, hi = v.field("lo").to_pylist(), v.field("hi").to_pylist()
            segments = [data[x : y - 1 + LENGTH] for x, y in zip(lo, hi)]
            yield pa.RecordBatch.from_arrays([*(v.field(x) for x in names), pa.array(segments, pa.binary())], names=[*names, "segment"])


def _sorted_shards(limit: int):
    """(shard, key, content, check, segment), in the order of shards, to the windows that occur again, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None

        def more() -> pa.RecordBatch | None:
            nonlocal pending
            while pending is None or not pending.num_rows:
                if (pending := next(batches, None)) is None:
                    return None
            return pending

        def rows(shard: int):
            nonlocal pending
            while (b := more()) is not None and b.column(0)[0].as_py() == shard:
                n = int(np.searchsorted(b.column(0).to_numpy(), shard, "right"))
                part, pending = b.slice(0, n), b.slice(n)
                yield list(zip(*(part.column(k).to_pylist() for k in (1, 2, 3)))), part.column(4).to_pylist()

        while (b := more()) is not None:
            for tags, x, y in repeats(rows(b.column(0)[0].as_py()), limit):
                yield pa.RecordBatch.from_arrays([*(pa.array(tags[:, k]) for k in range(3)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], names=[c.split()[0] for c in _HITS.split(", ")])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content, check, segment) to a row for every window of a segment, with 128 bits for its bytes."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = part.column(3).to_pylist()
            doc, at, _, _, one, two, first = _anchors(texts, LENGTH - GRAM + 1)
            tags = [part.column(k).take(pa.array(doc)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*tags, pa.array((at - first[doc]).astype(np.int32)), pa.array(one), pa.array(two)], names=["key", "content", "check", "x", "one", "two"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans of window starts) to the digest columns and the text that is left."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        left = []
        for d, t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = (t or "").encode("utf-8", "surrogatepass")
            removed = n = 0
            if spans.is_valid:
                v = spans.values
                lo, hi = np.asarray(v.field("lo")), np.asarray(v.field("hi")).astype(np.int64) - 1 + LENGTH
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, lo, 1)
                np.add.at(change, hi, -1)
                edge = np.flatnonzero(np.diff((np.cumsum(change[:-1]) > 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
                n = len(edge) // 2
                removed = sum(edge[1::2]) - sum(edge[::2])
                data, size = b"".join(data[a:b] for a, b in zip([0, *edge[1::2]], [*edge[::2], len(data)])), len(data)
            else:
                size = len(data)
            for c, x in zip(out, (d, size, removed, n, hashlib.sha256(data).hexdigest())):
                c.append(x)
            left.append(data)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every document.

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else too, in the same or another document;
    strings are judged on the input. Null and short texts keep everything; equal rows lose all that is long enough;
    rows without doc_id take part like others.

    Windows are grouped by anchors, so that equal windows share a key. Keys that occur once are dropped, and runs of
    equal content (by 128 bits) are counted as one. Where a key has several contents, the distinct segments of its runs
    go to shards by key, whose suffix arrays (see suffix_order) show the windows that occur again: a shard is read in
    batches and sorted in files, so its size is bound by disk. Keys of more than HOT contents are split further, into
    single windows, which are counted like contents. Rows are known by doc_id and a 64-bit hash of it and the text.
    An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"), F.coalesce("doc_id", F.lit(-1)).alias("did"))
    runs = base.select("rid", "did", "text").mapInArrow(_runs, _RUNS)
    differ = (F.min("content") != F.max("content")) | (F.min("check") != F.max("check"))
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), differ.alias("mixed")).where("n > 1").drop("n")
    keys = materialize(keys, "suffix-keys")  # a join of two scans can be split where a key is frequent
    again = materialize(runs.join(keys, "key"), "suffix-runs")
    discard(keys)
    mixed = again.where("mixed")
    same = ["key", "content", "check"]
    kinds = materialize(mixed.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "did", "lo", "hi")).alias("one")), "suffix-kinds")
    hot = materialize(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot")), "suffix-hot")
    marked = kinds.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = marked.groupBy(F.col("one.rid").alias("rid"), F.col("one.did").alias("did")).agg(F.collect_list(F.struct(*same, F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), "hot")).alias("wanted"))
    segments = base.join(wanted, ["rid", "did"]).select("text", "wanted").mapInArrow(_cut, "key long, content long, check long, hot boolean, segment binary")
    segments = materialize(segments.dropDuplicates(same), "suffix-segments")
    plain = segments.where("not hot")
    size = plain.agg(F.coalesce(F.sum(F.octet_length("segment")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD))
    dealt = plain.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), *same, "segment").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    sorted_ = dealt.mapInArrow(_sorted_shards(LIMIT), _HITS)
    windows = materialize(segments.where("hot").select(*same, "segment").mapInArrow(_windows, "key long, content long, check long, x int, one long, two long"), "suffix-windows")
    twice = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    split = windows.join(twice, ["one", "two"]).select(*same, "x", (F.col("x") + 1).alias("y"))
    once = kinds.where("n = 1").select(*same)
    found = materialize(sorted_.unionByName(split).join(once, same, "left_semi"), "suffix-found")
    whole = again.where("not mixed").select("rid", "did", "lo", "hi").unionByName(mixed.join(kinds.where("n > 1").select(*same), same, "left_semi").select("rid", "did", "lo", "hi"))
    single = found.join(kinds.select(*same, "one"), same).select("one.rid", "one.did", (F.col("one.lo") + F.col("x")).alias("lo"), (F.col("one.lo") + F.col("y")).alias("hi"))
    spans = materialize(whole.unionByName(single).groupBy("rid", "did").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix-spans")
    discard(again, kinds, hot, segments, windows, found)
    return base.join(spans, ["rid", "did"], "left").select("doc_id", "text", "spans").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
