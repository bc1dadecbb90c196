"""Benchmark decontamination by spaced-seed hashing with verification around the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, mix, rows_of, slices, small_batches

# Fixed masks: # is compared, - is ignored.
MASKS = ("###-#--#-##", "##-##-#--#-#", "#-#-###--##")
LEAST = 5  # benchmark items of fewer words are never looked for
OVERLAP = 13  # least words of an overlap, or the whole item if it is shorter
MISMATCH = 3.0  # what a substitution, or a word put in or left out, costs when a match earns 1
GAP = 4  # diagonals that lie so near are added up
BLOCK_BYTES = 8 << 20  # text of the benchmark that is broadcast at a time
BITS = 23
PAIRS = 1 << 20  # places of equal seeds that are expanded at a time
BAND = 1 << 15  # diagonals that are aligned at a time

_HIT = "doc_id long, digest long, item_id long, start long, end long, matched long, item_words long, share double"


def _seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the words under the mask at every place where it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt * 0x632BE59BD9B4E019 & (1 << 64) - 1, np.uint64)
    mult = mix(np.arange(1, len(mask) + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)
    for k, c in enumerate(mask):
        if c == "#":
            out += h[k : k + n] * mult[k]
    return mix(out)


class Index:
    """Seeds of a block of benchmark items: sorted hashes with item and places, and the items' words."""

    def __init__(self, items: list[tuple[int, str | None]]):
        w = Words([(t or "").encode("utf-8", "surrogatepass") for _, t in items])
        self.ids = [i for i, _ in items]
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(items))]
        span = max(map(len, MASKS))
        short = sorted({len(x) for x in self.words if LEAST <= len(x) < span})
        self.masks = [*MASKS, *("#" * n for n in short)]
        found = []
        for m, mask in enumerate(self.masks):
            for i, x in enumerate(self.words):
                if len(x) < LEAST or m >= len(MASKS) and len(x) != len(mask):
                    continue
                s = _seeds(x, mask, m)
                found.append((s, np.full(len(s), i), np.arange(len(s))))
        cat = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ()))]
        order = np.argsort(cat[0].astype(np.uint64), kind="stable")  # equal seeds stay in order of mask, item and place
        h, item, place = (x[order] for x in (cat[0].astype(np.uint64), cat[1].astype(np.int64), cat[2].astype(np.int64)))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        self.hash, self.item, self.place = h[first], item[first], place[first]  # runs of a seed from place to last
        self.last = place[np.append(first[1:], len(h)) - 1] if len(h) else place
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.hash >> np.uint64(64 - BITS)] = True

    def hits(self, w: Words) -> np.ndarray:
        """Distinct (document, item, first diagonal, last diagonal) of intervals of diagonals that hold a common seed.

        Seeds that repeat from place to place, in a text or an item, are met as runs: two runs share an interval of
        diagonals. What is left is expanded PAIRS at a time and merged, so memory grows with the intervals.
        """
        out = [np.zeros((0, 4), np.int64)]
        for m, mask in enumerate(self.masks):
            s = _seeds(w.hash, mask, m)
            if not len(s):
                continue
            at = np.flatnonzero(self.seen[s >> np.uint64(64 - BITS)])
            at = at[w.doc[at] == w.doc[at + len(mask) - 1]]
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (s[at[1:]] != s[at[:-1]]) | (w.doc[at[1:]] != w.doc[at[:-1]])
            first = np.flatnonzero(new)
            start, end = at[first], at[np.append(first[1:], len(at)) - 1]
            lo, hi = np.searchsorted(self.hash, s[start], "left"), np.searchsorted(self.hash, s[start], "right")
            some = hi > lo
            start, end, lo, hi = start[some], end[some], lo[some], hi[some]
            total = np.cumsum(hi - lo)
            cut = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(PAIRS, total[-1] if len(total) else 0, PAIRS)), [len(start)])))
            for x, y in zip(cut, cut[1:]):
                n = hi[x:y] - lo[x:y]
                k = np.repeat(lo[x:y], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a, b = np.repeat(start[x:y], n), np.repeat(end[x:y], n)
                out.append(_merged(np.stack((w.doc[a], self.item[k], a - self.last[k], b - self.place[k]), 1)))
                if sum(map(len, out)) > PAIRS:
                    out = [_merged(np.concatenate(out))]
        return _merged(np.concatenate(out))


def _merged(rows: np.ndarray) -> np.ndarray:
    """(document, item, first, last) in order, with intervals that meet made one."""
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    pair = np.cumsum(np.concatenate(([0], np.any(rows[1:, :2] != rows[:-1, :2], axis=1))))
    span = int(rows[:, 3].max() - rows[:, 2].min()) + 2
    last = np.maximum.accumulate(rows[:, 3] + pair * span) - pair * span  # of the pair's intervals so far
    new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (rows[1:, 2] > last[:-1] + 1)))
    first = np.flatnonzero(new)
    return np.column_stack((rows[first, :3], last[np.append(first[1:], len(rows)) - 1]))


def _align(text: np.ndarray, item: np.ndarray, low: int, high: int) -> tuple[int, int, int, int]:
    """The best local alignment of an item with the diagonals low to high of a text, and those up to GAP beside them.

    Item words that are aligned, start and end in the text, words that match. A cell (i, d) is word i of the item at
    place i + d of the text; each row holds score, start, matches and aligned words of the best way to its cells.
    """
    diag = np.arange(low - GAP, high + GAP + 1)
    slope = MISMATCH * np.arange(len(diag))
    row = np.zeros((4, len(diag)))
    best = (0.0, 0, 0, 0, 0)
    for i, word in enumerate(item):
        at = i + diag
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, len(text) - 1)] == word)
        fresh = row[0] <= 0
        pair = np.where(fresh, 0.0, row)
        pair[1, fresh] = at[fresh]
        pair[0] += np.where(same, 1.0, -MISMATCH)
        pair[0, ~inside] = -np.inf
        pair[2] += same
        pair[3] += 1
        # the item's word is left out: the text's place stays
        out = row[0, 1:] - MISMATCH > pair[0, :-1]
        pair[:, :-1][:, out] = row[:, 1:][:, out]
        pair[0, :-1][out] -= MISMATCH
        # words are put in: the item's word stays
        level = pair[0] + slope
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level >= top, np.arange(len(diag)), 0))
        put = top - slope > pair[0]
        pair[1:, put] = pair[1:, source[put]]
        pair[0] = np.maximum(pair[0], top - slope)
        row = pair
        k = int(np.argmax(row[0]))
        if row[0, k] > best[0]:
            best = (float(row[0, k]), int(row[3, k]), int(row[1, k]), int(at[k]) + 1, int(row[2, k]))
    return best[1:]


def _overlap(text: np.ndarray, item: np.ndarray, diagonals: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """The longest overlap: item words aligned, start less than zero, end, matches. Intervals of diagonals ascend."""
    cut = [k for k in range(1, len(diagonals)) if diagonals[k][0] - diagonals[k - 1][1] > 2 * GAP]
    found = []
    # an alignment loses as much by every diagonal it crosses as MISMATCH matches earn
    drift = int(len(item) / MISMATCH) + 1
    for a, b in zip([0, *cut], [*cut, len(diagonals)]):
        whole = next((d for lo, hi in diagonals[a:b] for d in range(max(lo, 0), min(hi, len(text) - len(item)) + 1) if text[d] == item[0] and np.array_equal(text[d : d + len(item)], item)), None)
        if whole is not None:
            found.append((len(item), -whole, whole + len(item), len(item)))
            continue
        low, high = diagonals[a][0], diagonals[b - 1][1]
        for lo in range(low, high + 1, BAND):
            n, s, e, m = _align(text, item, lo, min(high, lo + BAND + drift))
            found.append((n, -s, e, m))
    return max(found)


def _finder(index):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            rows = rows_of(batch)
            for part, texts in slices(rows, 2):
                w = Words(texts)
                places: dict[tuple, list] = {}
                for doc, item, lo, hi in ix.hits(w).tolist():
                    base = int(w.first[doc])
                    places.setdefault((doc, item), []).append((lo - base, hi - base))
                out = []
                for (doc, item), diagonals in places.items():
                    words = ix.words[item]
                    n, b, e, m = _overlap(w.hash[w.first[doc] : w.first[doc + 1]], words, diagonals)
                    if n >= min(len(words), OVERLAP):
                        out.append((*part[doc][:2], ix.ids[item], -b, e, m, len(words), n / len(words)))
                if out:
                    types = (*[pa.int64()] * 7, pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[x.split()[0] for x in _HIT.split(", ")])

    return find


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() with the hash of the document's text."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    found = None
    for k in range(blocks):
        items = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in items]))
        part = base.mapInArrow(_finder(index), _HIT)
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, matched, item_words, share): the longest overlap of each document with each item.

    Words are those of Words (A-Z lower-cased); start and end count the document's words; share is that of the item's
    words that are aligned. An overlap is a stretch of words in which a substitution, or a word put in or left out
    between neighbouring diagonals, costs three matches; it holds OVERLAP words of the item, however long the item is,
    or the whole item if it is shorter. Of equally long overlaps the first is given. Items shorter than the longest
    mask are also looked for as a whole; items of fewer than LEAST words, null and empty texts match nothing. A null
    doc_id or item_id is returned as null; repeated rows of either table give their rows again; without documents or
    items there are no rows. The benchmark is indexed and broadcast in blocks of about BLOCK_BYTES, however many it
    takes; every block meets all documents.
    """
    return _found(docs, benchmark).drop("digest")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps a benchmark item, with or without a doc_id; all columns stay.

    Rows that share a doc_id are judged each by its own text. Null and empty texts stay.
    """
    # written, so that its size is known: only a small table of leaks is broadcast by the join
    leaks = materialize(_found(docs, benchmark).select("doc_id", "digest").distinct(), "benchmark-leaks")
    d, text = leaks.toDF("leak of doc_id", "leak of text"), docs["text"].cast("string")
    return docs.join(d, docs["doc_id"].cast("long").eqNullSafe(d[0]) & (F.xxhash64(text) == d[1]), "left_anti")
