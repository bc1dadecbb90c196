import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import search as S

TERM = re.compile(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+")


def terms(t):
    return Counter(TERM.findall("".join(c.lower() if c.isascii() else c for c in t or "")))


def brute(texts, queries, top):
    t = {d: terms(x) for d, x in texts.items()}
    size = {d: sum(c.values()) for d, c in t.items()}
    n, mean = len(t), sum(size.values()) / len(t)
    df = Counter(w for c in t.values() for w in c)
    out = {}
    for q in queries:
        score = {}
        for d, c in t.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / mean)) for w in t[q] if w in c)
            if s > 0 and d != q:
                score[d] = round(s, 6)
        out[q] = sorted(((-v, d) for d, v in score.items()))[:top]
    return out


def same(rows, expected):
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    assert set(got) == {q for q, v in expected.items() if v}
    for q, v in got.items():
        assert [d for _, d in v] == [d for _, d in expected[q]]
        assert np.allclose([s for s, _ in v], [s for s, _ in expected[q]], atol=2e-6)


def test_all_documents_as_queries(spark, documents, texts):
    asked = [d for d in texts if d % 5 == 0]
    rows = S.search_every(documents, step=5).collect()
    same([r.asDict() for r in rows], brute(texts, asked, 10))


def test_ties_and_repeats(spark):
    docs = [(i, "common words here") for i in range(40)] + [(100, "common rare"), (101, "rare words"), (102, None), (103, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same([r.asDict() for r in S.search_every(df, step=100, top=5).collect()], brute(dict(docs), [0, 100], 5))


def test_blocks_of_queries(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BYTES", 20_000)
    same([r.asDict() for r in S.search_every(documents, step=20, top=3).collect()], brute(texts, [d for d in texts if d % 20 == 0], 3))


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_shards_and_thresholds_lose_nothing(texts, monkeypatch, size):
    monkeypatch.setattr(S, "SHARD_DOCS", size)
    monkeypatch.setattr(S, "slices", lambda rows, at, limit=4000: __import__("glossa.llm.common", fromlist=["slices"]).slices(rows, at, 4000))
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()))], names=["doc_id", "text"])
    shards = list(S._index(iter([batch])))
    n, words = (sum(b.column(k)[0].as_py() for b in shards) for k in (0, 1))
    q = S.Queries([(d, t) for d, t in texts.items() if d % 10 == 0])
    df = Counter(w for t in texts.values() for w in terms(t))
    hashed = {int(h): w for t in texts.values() for w, h in zip(TERM.findall("".join(c.lower() if c.isascii() else c for c in t)), S.Words([S._bare(t.encode())]).hash)}
    f = np.array([df[hashed[int(h)]] for h in q.terms], float)
    q.idf = np.log(1 + (n - f + 0.5) / (f + 0.5))

    class Shared:
        value = q

    rows = []
    for b in S._searcher(Shared, words / n, 10)(iter(shards)):
        for k, _, ids, scores in zip(*(c.to_pylist() for c in b.columns)):
            rows += [{"query_id": k, "rank": i, "doc_id": d, "score": s} for i, (d, s) in enumerate(zip(ids, scores))]
    same(rows, brute(texts, q.ids, 10))


def test_repeated_query_ids_are_answered_each(spark, documents, texts):
    from pyspark.sql import functions as F

    some = documents.where("doc_id in (3, 5)").select(F.col("doc_id").alias("query_id"), "text")
    other = documents.where("doc_id = 7").select(F.lit(3).alias("query_id"), "text")
    rows = S.search(documents, some.union(some).union(other)).collect()
    assert len(rows) == 50
    single = brute(texts, [3, 5], 10)
    for q in (3, 5):
        own = sorted((-r.score, r.doc_id) for r in rows if r.query_id == q)
        assert all(sum(d == x for _, d in own) >= 2 for _, x in single[q])


def test_blocks_below_the_threshold_are_skipped(texts, monkeypatch):
    """Postings of blocks that can't reach the threshold are never read, and nothing is lost by it."""
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()))], names=["doc_id", "text"])
    monkeypatch.setattr(S, "BLOCK", 2)
    monkeypatch.setattr(S, "SPARSE", 1.0 - 1e-9)
    row = next(iter(S._index(iter([batch]))))
    terms = np.frombuffer(row.column("terms")[0].as_buffer(), np.uint64)
    shard = S._Shard({c: row.column(c)[0].as_buffer() for c in ("ids", "lens", "terms", "ends", "docs", "tfs")}, row.column("words")[0].as_py() / len(texts), terms)
    read = []
    real = S._spread
    monkeypatch.setattr(S, "_spread", lambda a, b: read.append(int((b - a).sum())) or real(a, b))
    slots = np.arange(0, len(terms), 7)
    idf = np.linspace(0.5, 3, len(slots))
    ids, scores = shard.search(slots, idf, 0.0)
    whole, order = read[-1], np.argsort(-scores)
    for k in (1, 5, 50):
        read.clear()
        least = float(scores[order[k - 1]])
        got, s = shard.search(slots, idf, least)
        assert sorted(got) == sorted(ids[scores >= least - 1e-6]) and read[-1] < whole
    read.clear()
    assert len(shard.search(slots, idf, 1e9)[0]) == 0 and not read


def indexed(texts, asked):
    """Shards of texts, their query block with global statistics, and the mean length."""
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()))], names=["doc_id", "text"])
    shards = list(S._index(iter([batch])))
    n, words = (sum(b.column(k)[0].as_py() for b in shards) for k in (0, 1))
    q = S.Queries([(d, texts[d]) for d in asked])

    class Terms:
        value = q.terms

    got = next(S._frequencies(Terms)(iter([b.select(["terms", "ends"]) for b in shards])))
    f = got.column("df").to_numpy().astype(float)
    q.idf[got.column("k").to_numpy()] = np.log(1 + (n - f + 0.5) / (f + 0.5))
    return shards, q, words / n


def found(shards, q, mean, top=10):
    class Shared:
        value = q

    out = []
    for b in S._searcher(Shared, mean, top)(iter(shards)):
        for k, _, ids, scores in zip(*(c.to_pylist() for c in b.columns)):
            out += [{"query_id": k, "rank": i, "doc_id": d, "score": s} for i, (d, s) in enumerate(zip(ids, scores))]
    return out


@pytest.mark.parametrize("dense", [1e-9, 0.004, 2.0])
def test_groups_of_queries_meet_shards_at_once(texts, monkeypatch, dense):
    """No query looks at a shard alone, whose cost would be queries times shards; matrices of some terms, all or none lose nothing."""

    def alone(*_):
        raise AssertionError("a query by itself")

    monkeypatch.setattr(S, "SHARD_DOCS", 60)
    monkeypatch.setattr(S, "slices", lambda rows, at, limit=4000: __import__("glossa.llm.common", fromlist=["slices"]).slices(rows, at, 4000))
    monkeypatch.setattr(S._Shard, "search", alone)
    for k, v in (("DENSE", dense), ("GROUP", 7), ("TABLE", 4 * 64 * 5), ("AXES", 40)):
        monkeypatch.setattr(S, k, v)
    asked = [d for d in texts if d % 3 == 0]
    shards, q, mean = indexed(texts, asked)
    assert len(shards) > 2
    same(found(shards, q, mean), brute(texts, asked, 10))


def test_groups_and_single_queries_agree(monkeypatch):
    """Copies of a query, ids that repeat, ties at the threshold, queries without words and shards of one document."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(rng.choice(words[: 20 + i % 381], rng.integers(1, 120))) for i in range(300)}
    texts |= {300 + i: texts[i] for i in range(0, 60, 2)} | {400: "!!! ...", 401: "", 402: "w0", 403: "w0"}
    monkeypatch.setattr(S, "slices", lambda rows, at: __import__("glossa.llm.common", fromlist=["slices"]).slices(rows, at, 1))
    for size in (1, 50, 5000):
        monkeypatch.setattr(S, "SHARD_DOCS", size)
        shards, q, mean = indexed(texts, [d for d in texts if d % 2 == 0])
        assert len(shards) >= len(texts) // size - 1
        monkeypatch.setattr(S, "FEW", 1)
        together = found(shards, q, mean, 4)
        monkeypatch.setattr(S, "FEW", 10**9)
        assert together == found(shards, q, mean, 4)
        same(together, brute(texts, q.ids, 4))


def test_queries_without_words_have_an_order(monkeypatch):
    monkeypatch.setattr(S, "GROUP", 4)
    assert sorted(S.Queries([(i, "...") for i in range(50)]).ids) == list(range(50))


def test_queries_are_read_once_for_all_blocks(spark, documents, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "QUERY_BYTES", 20_000)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    asked = documents.where("doc_id % 20 = 0 and text <> ''").select(F.col("doc_id").alias("query_id"), "text")
    assert S.search(documents, asked.mapInArrow(count, "query_id long, text string"), 3).select("query_id").distinct().count() == read.value == asked.count()


def test_awkward_rows(awkward, nothing):
    rows = S.search_every(awkward, step=1).collect()
    assert {r.query_id for r in rows} >= {1, 8} and all(r.doc_id is not None for r in rows)
    assert S.search_every(nothing).count() == 0
