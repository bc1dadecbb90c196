"""Exact BM25 top-k: sharded inverted indexes with block-max dynamic pruning and global statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, discard, materialize, rows_of, slices, small_batches

K1, B = 1.2, 0.75
TOP = 10
SHARD_DOCS, SHARD_BYTES = 5000, 16 << 20  # of one shard; a document is never cut
QUERY_BYTES = 32 << 20  # text of the queries that are broadcast at a time
GROUP, AXES = 512, 256  # queries that meet a shard together, ordered by so many common words
FEW = 8  # fewer queries than that meet it one by one
DENSE = 0.004  # part of a group's pairs of query and document from which a term is a row of a matrix
TABLE = 16 << 20  # bytes of a matrix
BLOCK = 5  # 32 documents share a block maximum
EPS = 1e-6  # scores are compared after rounding to 6 decimals
SPARSE = 1 / 8  # share of blocks up to which only their own postings are read
SLACK = np.float32(1 + 1e-4)  # bounds are summed in single precision

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_SHARD = "n long, words long, ids binary, lens binary, terms binary, ends binary, docs binary, tfs binary"


def _bare(t: bytes) -> bytes:
    a = np.frombuffer(t, np.uint8)
    return np.where(_PUNCT[a], np.uint8(32), a).astype(np.uint8).tobytes()


def _shard(ids: list[int], lens: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple:
    term, doc, tf = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(term, kind="stable")  # documents are in order already
    term, doc, tf = term[order], doc[order], tf[order]
    terms, first = np.unique(term, return_index=True)
    ends = np.append(first[1:], len(term))[: len(terms)].astype(np.int32)
    return len(ids), int(lens.sum()), np.array(ids, np.int64).tobytes(), lens.astype(np.int32).tobytes(), terms.tobytes(), ends.tobytes(), doc.astype(np.int32).tobytes(), np.minimum(tf, 2**31 - 1).astype(np.int32).tobytes()


def _short(doc: np.ndarray, n: int) -> np.ndarray:
    """Documents' numbers below n in a type that is sorted by radix, if they fit."""
    return doc.astype(np.uint16) if n <= 1 << 16 else doc


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and frequency of the distinct words of each document, in the order of documents and hashes."""
    order = np.argsort(w.hash)
    order = order[np.argsort(_short(w.doc[order], len(w.first) - 1), kind="stable")]
    h, d = w.hash[order], w.doc[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, np.int64)
    return h[new], d[new], np.diff(np.append(new, len(h)))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted indexes of runs of documents: sorted term hashes, ends of their postings, documents and frequencies."""
    names = [x.split()[0] for x in _SHARD.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 6]

    def rows():
        for batch in batches:
            yield from rows_of(batch)

    ids: list[int] = []
    lens: list[np.ndarray] = []
    parts: list[tuple] = []
    size = 0
    for part, texts in slices(rows(), 1):
        w = Words([_bare(t) for t in texts])
        h, d, tf = _distinct(w)
        parts.append((h, d + len(ids), tf))
        lens.append(np.diff(w.first))
        ids += [r[0] for r in part]
        size += sum(map(len, texts))
        if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_shard(ids, np.concatenate(lens), parts), types)], names=names)
            ids, lens, parts, size = [], [], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_shard(ids, np.concatenate(lens), parts), types)], names=names)


def _frequencies(asked):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the asked terms, that are sorted: their places, and of how many documents they are words here."""
        df = np.zeros(len(asked.value), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                place, own = _among(asked.value, np.frombuffer(terms.as_buffer(), np.uint64))
                df[place] += np.diff(np.frombuffer(ends.as_buffer(), np.int32), prepend=0)[own]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["k", "df"])

    return count


def _among(asked: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the terms that are asked: places among the asked ones, and among all. Both are sorted."""
    place = np.minimum(np.searchsorted(asked, terms), max(len(asked) - 1, 0))
    own = np.flatnonzero(asked[place] == terms) if len(asked) else np.zeros(0, np.int64)
    return place[own], own


class Queries:
    """A block of queries: distinct terms, and for each query its terms' places among them; like queries are neighbours."""

    def __init__(self, rows: list[tuple[int, str]]):
        ids, count, terms = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for part, texts in slices(rows, 1):
            h, d, _ = _distinct(Words([_bare(t) for t in texts]))
            terms.append(h)
            count.append(np.bincount(d, minlength=len(part)))
            ids += [r[0] for r in part]
        self.terms, at = np.unique(np.concatenate(terms), return_inverse=True)
        count = np.concatenate(count)
        first = np.concatenate(([0], np.cumsum(count)))
        order = _alike(len(self.terms), at, np.repeat(np.arange(len(ids)), count), len(ids))
        self.ids = [ids[k] for k in order]
        self.at = at[_spread(first[order], first[order + 1])[0]].astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(count[order])))
        self.idf = np.zeros(len(self.terms))


def _alike(n_terms: int, at: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """An order of n queries in which those with the same common words are near each other: halved along main axes."""
    common = np.argsort(-np.bincount(at, minlength=n_terms), kind="stable")[:AXES]
    place = np.full(n_terms, -1)
    place[common] = np.arange(len(common))
    has = np.zeros((n, len(common)), np.float32)
    some = place[at] >= 0
    has[own[some], place[at[some]]] = 1
    done, left = [np.zeros(0, np.int64)], [np.arange(n)]
    while left:
        rows = left.pop()
        if len(rows) > GROUP // 2:
            x = has[rows] - has[rows].mean(0)
            along = x @ np.linalg.eigh(x.T @ x)[1][:, -1] if x.any() else np.zeros(len(x))
            rows, m = rows[np.argsort(along, kind="stable")], int((along < 0).sum())
            m = m if len(rows) // 16 < m < len(rows) - len(rows) // 16 else len(rows) // 2
            left += [rows[m:], rows[:m]]
        else:
            done.append(rows)
    return np.concatenate(done)


class _Shard:
    """One shard's index for the terms of a block of queries: postings with impacts, and block maxima.

    `most` has a row for each term that occurs here: its greatest impact in every block of neighbouring documents.
    """

    def __init__(self, row: dict, mean: float, asked: np.ndarray):
        self.ids = np.frombuffer(row["ids"], np.int64)
        lens = np.frombuffer(row["lens"], np.int32)
        terms = np.frombuffer(row["terms"], np.uint64)
        end = np.frombuffer(row["ends"], np.int32).astype(np.int64)
        self.asked, own = _among(asked, terms)
        self.slot = np.full(len(asked), -1, np.int32)
        self.slot[self.asked] = np.arange(len(own))
        at, self.count = _spread(np.concatenate(([0], end[:-1]))[own] if len(own) else own, end[own])
        self.doc = np.frombuffer(row["docs"], np.int32)[at].astype(np.int64)
        tf = np.frombuffer(row["tfs"], np.int32)[at].astype(np.float64)
        norm = K1 * (1 - B + B * lens / mean) if mean else np.full(len(lens), K1)
        self.impact = tf * (K1 + 1) / (tf + norm[self.doc])
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count
        self.top = np.maximum.reduceat(self.impact, self.start) if len(own) else np.zeros(0)

    @cached_property
    def term(self) -> np.ndarray:
        """Of each posting."""
        return np.repeat(np.arange(len(self.count)), self.count)

    @cached_property
    def key(self) -> np.ndarray:
        return self.term * len(self.ids) + self.doc  # ascending

    @cached_property
    def runs(self) -> np.ndarray:
        """Where runs of postings of one term in one block begin."""
        block = self.doc >> BLOCK
        return np.flatnonzero(np.concatenate(([True], (self.term[1:] != self.term[:-1]) | (block[1:] != block[:-1])))) if len(block) else np.zeros(0, np.int64)

    @cached_property
    def most(self) -> np.ndarray:
        out = np.zeros((len(self.count), (len(self.ids) >> BLOCK) + 1), np.float32)
        if len(self.doc):
            out[self.term[self.runs], self.doc[self.runs] >> BLOCK] = np.maximum.reduceat(self.impact, self.runs)
        return out

    @cached_property
    def by_doc(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Terms and impacts of postings in the order of documents, and where each document's begin."""
        order = np.argsort(_short(self.doc, len(self.ids)), kind="stable")
        return self.term[order], self.impact[order], np.concatenate(([0], np.cumsum(np.bincount(self.doc, minlength=len(self.ids))))).tolist()

    @cached_property
    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.ids, kind="stable")
        return self.ids[order], order

    def search(self, slots: np.ndarray, idf: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of at least `least` (all that match, if it is 0), by block-max WAND.

        Blocks in which the maxima of the query's terms add up to less than `least` are skipped with all their postings.
        Of the terms in the order of their bounds, the pivot is the first with which the sum reaches `least`: a document
        without it or a later one can't. The postings of those from the pivot on give candidates, a block's maxima of
        the terms before it decide which of them are left, and these are completed, the strongest terms first.
        """
        none = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(idf * self.top[slots], kind="stable")
        slots, idf = slots[order], idf[order]
        total = np.cumsum(idf * self.top[slots]) * SLACK
        m = int(np.searchsorted(total, least - EPS))
        n = len(self.ids)
        if m == len(slots):
            return none
        rest = idf[:m].astype(np.float32) @ self.most[slots[:m]] * SLACK
        alive = rest + idf[m:].astype(np.float32) @ self.most[slots[m:]] * SLACK >= least - EPS
        if not alive.any():
            return none
        if alive.mean() > SPARSE:  # cheaper than picking out the others; candidates of dead blocks go below
            at, count = _spread(self.start[slots[m:]], self.end[slots[m:]])
            weight = np.repeat(idf[m:], count)
        else:
            first = np.searchsorted(self.term[self.runs], np.concatenate((slots[m:], slots[m:] + 1))).reshape(2, -1)
            e, count = _spread(*first)
            keep = np.flatnonzero(alive[self.doc[self.runs[e]] >> BLOCK])
            e, weight = e[keep], np.repeat(idf[m:], count)[keep]
            at, count = _spread(self.runs[e], np.append(self.runs[1:], len(self.doc))[e])
            weight = np.repeat(weight, count)
        score = np.bincount(self.doc[at], weights=self.impact[at] * weight, minlength=n)
        if not m:
            found = np.flatnonzero(score > 0 if least <= 0 else score >= least - EPS)
            return found, score[found]
        found = np.flatnonzero(score + np.repeat(np.where(alive, rest, -np.inf), 1 << BLOCK)[:n] >= least - EPS)
        left = float(total[m - 1])
        s = score[found]
        for hi in range(m, 0, -16):
            keep = s + left >= least - EPS
            found, s = found[keep], s[keep]
            if not len(found):
                break
            lo = max(0, hi - 16)
            want = (slots[lo:hi, None] * n + found[None, :]).ravel()
            p = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            gain = np.where(self.key[p] == want, self.impact[p], 0).reshape(hi - lo, -1)
            s = s + idf[lo:hi] @ gain
            left = float(total[lo - 1]) if lo else 0.0
        keep = s >= least - EPS
        return found[keep], s[keep]

    def search_each(self, q: Queries, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k in range(len(q.ids)):
            at = q.at[q.first[k] : q.first[k + 1]]
            slots = self.slot[at]
            found, scores = self.search(slots[slots >= 0], q.idf[at[slots >= 0]], least[k])
            if len(found):
                yield k, found, scores

    def search_all(self, q: Queries, least: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its candidates: documents and scores, all that can be among the `top` of other ids.

        The same as search() for groups of queries at once. Queries whose terms' greatest impacts add up to less than `least`
        skip the shard. Terms that many of a group and many documents have come before the pivot: the other terms' postings
        are added up first, and only queries that can then still reach `least` get those before the pivot, for the group as
        one product of matrices. These sums are in single precision and choose candidates, with their greatest error
        allowed for; candidates are scored anew.
        """
        idf = q.idf[self.asked]
        value, high = (self.impact * np.repeat(idf, self.count)).astype(np.float32), self.top * idf
        n, wide = len(self.ids), -(-len(self.ids) >> BLOCK)
        size = wide << BLOCK
        ids, by_id = self.by_id
        terms_of, impact_of, first = self.by_doc
        weight, dim = np.zeros(len(idf)), np.zeros(len(idf), np.int64)
        step = max(1, min(GROUP, TABLE // (4 * size)))
        for lo in range(0, len(q.ids), step):
            m = min(step, len(q.ids) - lo)
            slot = self.slot[q.at[q.first[lo] : q.first[lo + m]]]
            row = np.repeat(np.arange(m), np.diff(q.first[lo : lo + m + 1]))[slot >= 0]
            slot = slot[slot >= 0]
            own = np.searchsorted(row, np.arange(m + 1))
            slack = 1 + (np.diff(own) + 16) * 2.0**-22
            low = least[lo : lo + m] - EPS
            live = np.bincount(row, high[slot], m) * slack >= low
            before = np.bincount(slot, minlength=len(idf)) * self.count >= DENSE * m * n
            dense = before[slot]
            rare = ~dense & live[row]

            total = np.zeros((m, size), np.float32)
            s, r = slot[rare], row[rare]
            count = self.count[s]
            end = np.cumsum(count)
            edge = np.searchsorted(r, np.arange(m + 1))
            past = np.concatenate(([0], end))[edge]
            base = self.start[s] - end + count + past[r]
            run = np.arange(np.diff(past).max())
            for k in np.flatnonzero(np.diff(past)):
                at = np.repeat(base[edge[k] : edge[k + 1]], count[edge[k] : edge[k + 1]])
                at += run[: len(at)]
                np.add.at(total[k], self.doc.take(at), value.take(at))

            r, s = row[dense], slot[dense]
            live &= (total.max(1) + np.bincount(r, high[s], m)) * slack >= low
            some, terms = np.flatnonzero(live), np.flatnonzero(before)
            at = np.cumsum(live) - 1
            r, s = at[r[live[r]]], s[live[r]]
            dim[terms] = np.arange(len(terms))
            width = max(1, TABLE // (4 * size))
            for a in range(0, len(terms) if len(some) else 0, width):
                t = terms[a : a + width]
                at, count = _spread(self.start[t], self.end[t])
                x = np.zeros((len(t), size), np.float32)
                x[np.repeat(np.arange(len(t)), count), self.doc[at]] = value[at]
                d = dim[s] - a
                y = np.zeros((len(some), len(t)), np.float32)
                y[r[(d >= 0) & (d < len(t))], d[(d >= 0) & (d < len(t))]] = 1
                if len(some) == m:
                    total += y @ x
                else:
                    total[some] += y @ x

            same = np.array(q.ids[lo : lo + m])
            a, b = np.searchsorted(ids, same), np.searchsorted(ids, same, "right")
            for k in np.flatnonzero(a < b):
                total[k, by_id[a[k] : b[k]]] = 0
            cell = total.reshape(m, 1 << BLOCK, wide)
            peak = cell.max(1)
            if wide >= top:  # so many documents have at least that
                low = np.maximum(low, np.partition(peak, wide - top, 1)[:, wide - top] / slack - EPS)
            limit = np.where(live, low / slack, np.inf)
            r, b = np.nonzero((peak > 0) & (peak >= limit[:, None]))
            x = cell[r, :, b]
            i, a = np.nonzero((x > 0) & (x >= limit[r, None]))
            edge, doc = np.searchsorted(r[i], np.arange(m + 1)), a * wide + b[i]
            for k in np.flatnonzero(np.diff(edge)):
                found, s = doc[edge[k] : edge[k + 1]], slot[own[k] : own[k + 1]]
                weight[s] = idf[s]
                yield lo + k, found, np.array([weight.take(terms_of[first[d] : first[d + 1]]) @ impact_of[first[d] : first[d + 1]] for d in found.tolist()])
                weight[s] = 0


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start .. end - 1 of every range in a row, and how many each has."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def _searcher(shared, mean: float, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q.ids)
        least = np.zeros(len(q.ids))
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Shard({c: batch.column(c)[i].as_buffer() for c in ("ids", "lens", "terms", "ends", "docs", "tfs")}, mean, q.terms)
                for k, found, new in shard.search_all(q, least, top) if len(q.ids) >= FEW else shard.search_each(q, least):
                    got = shard.ids[found]
                    other = got != q.ids[k]
                    ids, scores = best[k]
                    ids, scores = np.concatenate((ids, got[other])), np.concatenate((scores, np.round(new[other], 6)))
                    if len(ids) > 8 * top:
                        cut = np.partition(scores, len(scores) - top)[len(scores) - top]
                        ids, scores = ids[scores >= cut], scores[scores >= cut]
                    order = np.lexsort((ids, -scores))[:top]
                    best[k] = ids[order], scores[order]
                    if len(order) == top:
                        least[k] = scores[order[-1]]
        some = [k for k in range(len(q.ids)) if len(best[k][0])]
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array([q.ids[k] for k in some], pa.int64()), pa.array(some, pa.int64()), pa.array([best[k][0] for k in some], pa.list_(pa.int64())), pa.array([best[k][1] for k in some], pa.list_(pa.float64()))],
                names=["query_id", "n", "ids", "scores"],
            )

    return search


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each shard of documents with a doc_id; see _index. Written in the shared folder."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_index, _SHARD), "search-index")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, doc_id, score: for each row of queries(query_id, text) the `top` documents of highest BM25 score.

    The query is every distinct word of the whole text (runs of characters other than white space and ASCII signs, A-Z
    lower-cased). score = sum of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length /
    mean)), rounded to 6 decimals; N, df and mean are of all documents. Ties are ordered by doc_id. A document is not a
    result of its own id; documents without a common word are none. Null or empty texts are empty documents and give
    queries without rows; rows without id are left out; without documents or queries there are no rows. Repeated rows
    of docs are documents of their own, and each row of queries is answered for itself, also if its id repeats.

    Queries are broadcast in blocks of about QUERY_BYTES of text, one after the other; each block meets all shards, in
    groups of GROUP like queries at once. A task carries a query's best scores from shard to shard as the threshold and
    returns one row for each query.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    index = build_index(docs)
    n, words = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean = words / n if n else 0.0
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).where("query_id is not null and octet_length(text) > 0")
    asked = materialize(asked, "search-asked")  # each block reads it
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    tasks = 2 * spark.sparkContext.defaultParallelism
    found = None
    for k in range(blocks):
        q = Queries([(r[0], r[1]) for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).collect()])
        terms = spark.sparkContext.broadcast(q.terms)
        got = index.select("terms", "ends").coalesce(tasks).mapInArrow(_frequencies(terms), "k long, df long").groupBy("k").agg(F.sum("df").alias("df")).toArrow()
        terms.unpersist()
        f = got.column("df").to_numpy().astype(np.float64)
        q.idf[got.column("k").to_numpy()] = np.log(1 + (n - f + 0.5) / (f + 0.5))
        shared = spark.sparkContext.broadcast(q)
        part = index.select("ids", "lens", "terms", "ends", "docs", "tfs").coalesce(tasks).mapInArrow(_searcher(shared, mean, top), "query_id long, n long, ids array<long>, scores array<double>")
        part = materialize(part.withColumn("block", F.lit(k)), "search-found")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    discard(asked)
    each = found.select("query_id", "block", "n", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", "block", "n", F.col("x.ids").alias("doc_id"), F.col("x.scores").alias("score"))
    by = W.partitionBy("query_id", "block", "n").orderBy(F.desc("score"), "doc_id")
    return each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def search_every(docs: DataFrame, step: int = 100, top: int = TOP) -> DataFrame:
    """search() with the rows whose doc_id is divisible by `step` as queries, against all rows."""
    return search(docs, docs.where(F.col("doc_id") % step == 0).select(F.col("doc_id").alias("query_id"), "text"), top)
