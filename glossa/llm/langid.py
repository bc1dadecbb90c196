"""Language identification by prediction by partial matching (PPM) with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, slices, small_batches

ORDER = 3
LEAST = 4  # a context of the longest order needs so many occurrences in some language
ALPHABET = 230  # byte values that are left when A-Z are lower-cased
TABLE_BYTES = 8 << 20  # of code lengths for each language, and
TABLE_LANGS = 16  # for so many languages at most: bounds the broadcast table
TRAIN_DOCS = 400  # whole documents for each language, those of least hash
MAX_LANGS = 256  # bounds the counts that the driver gets

_PAD = b"\n" * ORDER
_COUNTS = "lang int, gram long, n long"


def _grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of a lower-cased text with the ORDER bytes before it, as a number in base 256, and how often it occurs."""
    s = LOWER[np.frombuffer(_PAD + text, np.uint8)]
    return np.unique(_codes(s, ORDER + 1, 256), return_counts=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number of the language, text) to (lang, gram, n)."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams, n = _grams(text.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), lang, np.int32)), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """Code lengths in bits of every byte in every context of the languages' trees.

    counts are held by language for contexts of 0 to ORDER bytes. The probability of a byte is PPM's with
    escape method C and exclusions: seen bytes get n / (total + kinds), an escape gets kinds / (total + kinds)
    and leads to the context without its oldest byte; below order 0 the bytes not yet excluded are equal.
    Each byte that occurs in training has a symbol of its own; one more stands for each of the others, which are
    alike in every context, so that the code lengths are exact for any text.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: for each language the grams of its texts (see _grams) and how often they occur."""
        self.langs = sorted(counts)
        seen = np.unique(np.concatenate([counts[k][0] for k in self.langs]) & 255) if counts else np.zeros(0, np.int64)
        own = np.union1d(seen, [10])
        self.n = n = len(own) + 1
        self.symbol = np.zeros(256, np.int64)
        self.symbol[own] = np.arange(1, n)
        self.symbol = self.symbol[LOWER]
        seq = {}  # grams in base n, with their counts
        for k, (grams, times) in counts.items():
            code = np.zeros(len(grams), np.int64)
            for i in range(ORDER, -1, -1):
                code = code * n + self.symbol[(grams >> 8 * i) & 255]
            seq[k] = code, times
        # contexts kept at each order: codes in base n, the oldest byte first
        keep = [np.zeros(1, np.int64)]
        budget = max(n * 2, TABLE_BYTES * min(len(self.langs), TABLE_LANGS) // (4 * n * max(1, len(self.langs))))
        for k in range(1, ORDER + 1):
            most = np.zeros(n**k, np.int64)
            for code, times in seq.values():
                np.maximum(most, np.bincount(code // n % n**k, weights=times, minlength=n**k).astype(np.int64), out=most)
            found = np.flatnonzero(most >= (1 if k < ORDER else LEAST))
            room = max(0, budget - sum(map(len, keep)))
            if len(found) > room:
                found = np.sort(found[np.argsort(-most[found], kind="stable")[:room]])
            keep.append(found)
        base = np.cumsum([0, *map(len, keep)])
        total = int(base[-1])
        # the longest kept suffix of every history of ORDER symbols
        self.node = np.zeros(n**ORDER, np.int32)
        short = []  # for each order, code -> node
        for k in range(ORDER + 1):
            m = np.full(n**k, -1, np.int32)
            m[keep[k]] = base[k] + np.arange(len(keep[k]))
            short.append(m)
            to = np.tile(m, n ** (ORDER - k))
            self.node[to >= 0] = to[to >= 0]
        self.cost = np.zeros((total * n, len(self.langs)), np.float32)
        for j, lang in enumerate(self.langs):
            code, times = seq[lang]
            seen_in = np.zeros((total, n), np.float64)
            for k in range(ORDER + 1):
                nodes = short[k][code // n % n**k]
                ok = nodes >= 0
                seen_in += np.bincount(nodes[ok].astype(np.int64) * n + code[ok] % n, weights=times[ok], minlength=total * n).reshape(total, n)
            for k in range(ORDER + 1):
                p = np.zeros((len(keep[k]), n))
                escape = np.ones((len(keep[k]), 1))
                excluded = np.zeros_like(p, bool)
                for o in range(k, -1, -1):
                    at = short[o][keep[k] % n**o]
                    c = np.where(excluded, 0, seen_in[at]) * (at >= 0)[:, None]
                    total_c, kinds = c.sum(1, keepdims=True), np.count_nonzero(c, 1)[:, None]
                    some = np.maximum(total_c + kinds, 1)
                    p = np.where(c > 0, escape * c / some, p)
                    escape = np.where(total_c > 0, escape * kinds / some, escape)
                    excluded |= c > 0
                p = np.where(excluded, p, escape / np.maximum(ALPHABET - excluded.sum(1, keepdims=True), 1))
                self.cost[base[k] * n : base[k + 1] * n, j] = -np.log2(np.maximum(p, 1e-300)).ravel()

    @classmethod
    def of_texts(cls, texts: dict[str, list[bytes]]) -> Model:
        """From the texts of each language themselves; for small sets and tests."""
        counts = {}
        for lang, own in texts.items():
            grams, n = (np.concatenate(x) for x in zip(*map(_grams, own)))
            kinds, at = np.unique(grams, return_inverse=True)
            counts[lang] = kinds, np.bincount(at, weights=n).astype(np.int64)
        return cls(counts)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, every byte counted."""
        out = np.zeros((len(texts), len(self.langs)))
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        some = np.flatnonzero(lens > 0)
        if not len(some) or not self.langs:
            return out
        s = self.symbol[np.frombuffer(b"".join(_PAD + texts[i] for i in some), np.uint8)]
        cell = self.node[_codes(s, ORDER, self.n)[: len(s) - ORDER]].astype(np.int64) * self.n + s[ORDER:]
        first = np.cumsum(lens[some] + ORDER) - (lens[some] + ORDER)
        edge = np.stack((first, first + lens[some]), 1).ravel()
        for j in range(len(self.langs)):
            c = np.append(self.cost[cell, j], np.float32(0)).astype(np.float64)
            out[some, j] = np.add.reduceat(c, np.minimum(edge, len(c) - 1))[::2]
        return out


def _codes(s: np.ndarray, k: int, n: int) -> np.ndarray:
    """Number in base n of every k symbols in a row."""
    out = np.zeros(max(0, len(s) - k + 1), np.int64)
    for i in range(k):
        out *= n
        out += s[i : i + len(out)]
    return out


def _letters(t: str | None) -> bool:
    return bool(t) and any(map(str.isalpha, t))


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            asked = ((i, t) for i, t in enumerate(texts) if m.langs and _letters(t))
            for part, data in slices(asked, 1):
                bits = m.bits(data)
                best = bits.argmin(1)
                p = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                for k, (i, _) in enumerate(part):
                    langs[i], scores[i] = m.langs[best[k]], float(p[k])
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return score


def _held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame) -> Model:
    """A model of the non-null lang values of documents that are not held out.

    The sample is bounded: for each language the TRAIN_DOCS different documents of least hash of doc_id and text, whole.
    Rows whose hash lies above twice the share that is needed are left out first, so no task sees more than a bounded
    number of a language's rows. Contexts are counted on Spark; the driver gets the counts of different grams.
    """
    pool = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out())
    sizes = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return Model({})
    names = sorted(r[0] for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], min(1.0, 2 * TRAIN_DOCS / r[1]))])
    number = F.create_map(*[F.lit(x) for pair in zip(names, range(len(names))) for x in pair])
    h = F.xxhash64("doc_id", "text")
    few = pool.withColumn("h", h).where(F.pmod("h", F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40)).dropDuplicates(["lang", "h"])
    by = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h")
    chosen = few.withColumn("r", F.row_number().over(by)).where(F.col("r") <= TRAIN_DOCS).select(number[F.col("lang")].alias("lang"), "text")
    found = chosen.mapInArrow(_counted, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (found.column(c).to_numpy() for c in ("lang", "gram", "n"))
    order = np.argsort(lang, kind="stable")
    cut = np.searchsorted(lang[order], np.arange(len(names) + 1))
    return Model({k: (gram[order[a:b]], n[order[a:b]]) for k, a, b in zip(names, cut, cut[1:])})


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; the whole text is scored.

    lang_pred is a learned language, or `und` with score 0 if the text is null or has no letter or nothing was
    learned. score is the share of the best language's probability among all, at equal priors. A null doc_id counts
    as the empty text for the fold. Rows that repeat are predicted each on its own.
    """
    small_batches(docs.sparkSession)
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, model: Model | None = None) -> DataFrame:
    """docs without the rows whose language is undetermined or whose score is below `least`. All columns stay as they are."""
    small_batches(docs.sparkSession)
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    rows = plain.withColumn("__text", F.col(names[docs.columns.index("text")]).cast("string"))
    schema = T.StructType([*plain.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    scored = rows.mapInArrow(_passing(shared), schema)
    return scored.where((F.col("__lang") != "und") & (F.col("__score") >= least)).drop("__lang", "__score").toDF(*docs.columns)


def _passing(shared):
    score = _scorer(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in score(batches):
            yield out.rename_columns([*out.schema.names[:-2], "__lang", "__score"])

    return run
