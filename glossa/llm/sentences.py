"""Substring deduplication on sliding runs of several consecutive sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, materialize, mix, rows_of, slices, small_batches

SENTENCES = 3  # least sentences of a run
LEAST = 24  # least words of a run
LONGEST = 16  # a sentence is cut after so many words, before words whose last byte is a multiple of CUT,
CUT = 4
PIECE = 64  # and at every PIECE-th word

_SPAN = "doc_id long, start int, h1 long, h2 long"


def _units(w: Words) -> np.ndarray:
    """First word of every sentence: after . ! or ?, after a line break, and within long sentences.

    The cuts of a long sentence follow its words, so that a passage is cut alike wherever it stands in one.
    """
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64)
    lines = np.concatenate(([0], np.cumsum(w.buf == 10)))
    new = np.ones(n, bool)
    last = w.buf[w.end[:-1] - 1]
    new[1:] = (last == 46) | (last == 33) | (last == 63) | (lines[w.start[1:]] > lines[w.end[:-1]])
    new[w.first[:-1][np.diff(w.first) > 0]] = True
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    new |= (since >= LONGEST) & (w.buf[w.end - 1] % CUT == 0) | (since % PIECE == 0)
    return np.flatnonzero(new)


def _runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and two hashes of the shortest run from each sentence on, and of the shortest up
    to each sentence, that have SENTENCES sentences and LEAST words.

    Any longer run is made of these: its sentences are covered by the shortest runs from its sentences on that fit into
    it, and the last ones by the shortest run up to its end. So they stand for every run.
    """
    unit = _units(w)
    edge = np.append(unit, len(w.hash))
    if not len(unit):
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64), z.view(np.uint64)
    last = np.maximum(np.arange(len(unit)) + SENTENCES, np.searchsorted(edge, unit + LEAST))
    ok = np.flatnonzero(last < len(edge))
    first = np.minimum(np.arange(1, len(edge)) - SENTENCES, np.searchsorted(edge, edge[1:] - LEAST, "right") - 1)
    up = np.flatnonzero(first >= 0)
    run = np.unique(np.concatenate((ok * len(edge) + last[ok], first[up] * len(edge) + up + 1)))
    start, end = edge[run // len(edge)], edge[run % len(edge)]
    same = w.doc[start] == w.doc[end - 1]
    start, end = start[same], end[same]
    out = []
    for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
        h = mix(w.hash * np.uint64(salt) + np.uint64(salt >> 7))
        p = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _odd(len(h), salt)[0])))
        out.append(mix((p[end] - p[start]) * _odd(len(h) + 1, salt)[1][start] + (end - start).astype(np.uint64)))
    return start, end, out[0], out[1]


_ODD: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _odd(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a salt's odd base and of its inverse, modulo 2**64."""
    if salt not in _ODD or len(_ODD[salt][0]) < n:
        base = (salt ^ 0x5851F42D4C957F2D) | 1
        made = []
        for v in (base, pow(base, -1, 1 << 64)):
            a = np.full(n, v, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _ODD[salt] = tuple(made)
    a, b = _ODD[salt]
    return a[:n], b[:n]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = rows_of(batch)
        for part, texts in slices(rows, 1):
            w = Words(texts)
            start, _, h1, h2 = _runs(w)
            doc = w.doc[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in part], pa.int64()).take(pa.array(doc)), pa.array((start - w.first[doc]).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                names=["doc_id", "start", "h1", "h2"],
            )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, h1) of every run of sentences that is not the first of its kind, start in words; written.

    First is the least (doc_id, start); the hash of a run has 128 bits. Counting combines on the map side,
    so a line that a third of all documents hold is one row of each task.
    """
    spans = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_spans, _SPAN)
    kinds = spans.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    kinds = materialize(kinds, "sentences-kinds")  # a join of two scans can be split where a hash is frequent
    flagged = spans.join(kinds, ["h1", "h2"]).where(~(F.struct("doc_id", "start").eqNullSafe(F.col("least")))).select("doc_id", "start", "h1")
    out = materialize(flagged, "sentences-spans")
    discard(kinds)
    return out


def _remover(text_at: int, names: list[str]):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1)
            removed, words = [0] * len(texts), [0] * len(texts)
            asked = [(i, texts[i]) for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)) if texts[i]]
            for part, data in slices(asked, 1):
                w = Words(data)
                start, end, h1, _ = _runs(w)
                doc, unit = w.doc[start], _units(w)
                cut = np.searchsorted(doc, np.arange(len(data) + 1))
                for k, (i, _) in enumerate(part):
                    own = slice(cut[k], cut[k + 1])
                    flagged = {(x["start"], x["h1"]) for x in spans[i].as_py()}
                    base = w.first[k]
                    hit = np.array([x in flagged for x in zip((start[own] - base).tolist(), h1[own].view(np.int64).tolist())], bool)
                    gone = np.zeros(w.first[k + 1] - base + 1, np.int32)
                    np.add.at(gone, start[own][hit] - base, 1)
                    np.add.at(gone, end[own][hit] - base, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    if not gone.any():
                        continue
                    # a kept word keeps the white space after it; so does the text before the first word
                    at = np.append(w.start[base : w.first[k + 1]], w.at[k + 1] - 1) - w.at[k]
                    change = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
                    kept, last = [], 0
                    for s, e in zip(change[::2], change[1::2]):
                        kept.append(data[k][last : at[s]])
                        last = at[e]
                    kept.append(data[k][last:])
                    texts[i] = b"".join(kept).decode("utf-8", "surrogatepass")
                    words[i] = int(gone.sum())
                    removed[i] = int(np.count_nonzero(gone[unit[(unit >= base) & (unit < w.first[k + 1])] - base]))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int64()), pa.array(words, pa.int64())], names=names)

    return remove


def dedup_sentences(docs: DataFrame) -> DataFrame:
    """docs with the sentences of every non-first repeated run cut from text, and n_sentences_removed, n_words_removed.

    All columns stay; a column of docs with one of the two added names is replaced. Null and empty texts, texts
    with too few words for a run, and rows without doc_id stay as they are. Rows that share a doc_id count as
    one place: of equal rows each keeps what the first keeps. An empty table gives an empty table.
    """
    added = ("n_sentences_removed", "n_words_removed")
    small_batches(docs.sparkSession)
    docs = docs.drop(*added)
    flags = repeated_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "h1")).alias("spans")).withColumnRenamed("doc_id", "__flag_id")
    names = [f"__c{i}" for i in range(len(docs.columns))]
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    plain = docs.toDF(*names).withColumn(names[text_at], F.col(names[text_at]).cast("string"))
    joined = plain.join(flags, F.col(names[id_at]).cast("long") == F.col("__flag_id"), "left").select(*names, "spans")
    schema = T.StructType([*plain.schema.fields, *(T.StructField(x, T.LongType()) for x in added)])
    return joined.mapInArrow(_remover(text_at, schema.names), schema).toDF(*docs.columns, *added)
