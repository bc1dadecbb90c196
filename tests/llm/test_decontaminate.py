import random

import numpy as np

from glossa.llm import decontaminate as D


def words(rnd, n):
    return [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]


def brute(docs: dict, items: dict) -> set:
    """Pairs whose best alignment over all diagonals is long enough."""
    out = set()
    tokens = lambda t: D.Words([t.encode()]).hash
    texts = {d: tokens(t) for d, t in docs.items() if t}
    for i, t in items.items():
        item = tokens(t)
        if len(item) < D.LEAST:
            continue
        for d, text in texts.items():
            if np.isin(text, item).sum() >= D.LEAST:
                n = D._align(text, item, -len(item), len(text))[0]
                if n >= min(len(item), D.OVERLAP):
                    out.add((d, i))
    return out


def local_alignment(text, item):
    """Score of the best local alignment, from the definition."""
    best, row = 0, [0] * (len(text) + 1)
    for y in item:
        new = [0]
        for j, x in enumerate(text):
            new.append(max(0, row[j] + (1 if x == y else -3), row[j + 1] - 3, new[-1] - 3))
        row = new
        best = max(best, *row)
    return best


def test_alignment_equals_the_definition():
    rnd = random.Random(7)
    for _ in range(200):
        text, item = (np.array([rnd.randint(0, 3) for _ in range(rnd.randint(1, 30))]) for _ in range(2))
        n, s, e, m = D._align(text, item, -len(item), len(text))
        want = local_alignment(text.tolist(), item.tolist())
        assert (m > 0) == (want > 0) and local_alignment(text[s:e].tolist(), item.tolist()) == want


def test_exact_passages(documents, benchmark_items, texts):
    norm = lambda t: " " + " ".join((t or "").lower().split()) + " "
    items = {r.item_id: norm(r.text) for r in benchmark_items.collect()}
    expected = {(d, i) for d, t in texts.items() for i, x in items.items() if x in norm(t)}
    got = {(r.doc_id, r.item_id) for r in D.contamination(documents, benchmark_items).collect()}
    assert expected <= got
    assert got == brute(texts, {r.item_id: r.text for r in benchmark_items.collect()})


def test_recall_under_substitutions(spark):
    rnd = random.Random(11)
    items = {i: words(rnd, rnd.choice((20, 40, 100))) for i in range(240)}
    docs = {}
    for i, item in items.items():
        rate = rnd.choice((0.05, 0.1, 0.15, 0.2))
        docs[i] = " ".join(words(rnd, 20) + [x if rnd.random() > rate else "other" for x in item] + words(rnd, 20))
    named = {i: " ".join(x) for i, x in items.items()}
    got = D.contamination(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(named.items()), "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    expected = {p for i in docs for p in brute({i: docs[i]}, {i: named[i]})}
    assert got <= expected and len(got) >= 0.99 * len(expected) > 150


def test_repetitive_texts_take_bounded_memory():
    import tracemalloc

    for word, other in (("x", "x"), ("x", "y"), ("x", "x y z")):
        index = D.Index([(1, f"{word} {other} " * 200)])
        text = D.Words([(f"{word} {other} " * 30_000).encode()])
        tracemalloc.start()
        hits = index.hits(text)
        assert len(hits) and (hits[:, 3] - hits[:, 2] + 1).sum() > 20_000
        n, _, _, m = D._overlap(text.hash, index.words[0], [(a, b) for _, _, a, b in hits.tolist()])
        assert n == m == len(index.words[0])
        index.words[0] = np.concatenate((index.words[0][:300], index.words[0][:1] + np.uint64(1), index.words[0][300:]))
        assert D._overlap(text.hash, index.words[0], [(a, b) for _, _, a, b in hits.tolist()])[3] >= 300
        assert tracemalloc.get_traced_memory()[1] < 500 << 20
        tracemalloc.stop()


def test_leaks_without_or_with_repeated_ids_go(spark):
    rnd = random.Random(3)
    item = " ".join(words(rnd, 30))
    items = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, f"a {item} b", 1), (None, "clean text of a row without number", 2), (5, item, 3), (5, "clean too", 4), (None, None, 5)], "doc_id long, text string, digest int")
    assert {r.digest for r in D.decontaminate(docs, items).collect()} == {2, 4, 5}
    assert D.contamination(docs, items).count() == 6


def test_substitutions_and_partial_overlaps(spark):
    rnd = random.Random(1)
    items = [words(rnd, 40) for _ in range(30)]
    docs, leaks = [], set()
    for i, item in enumerate(items):
        v = list(item)
        kind = i % 4
        if kind == 1:
            for k in range(rnd.randint(0, 6), 40, 7):
                v[k] = "other"
        if kind == 2:
            v = v[5:30]
        if kind == 3:
            v = v[:8]  # too little
        docs.append((i, " ".join(words(rnd, 30) + v + words(rnd, 30))))
        if kind != 3:
            leaks.add((i, i))
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == leaks
    assert all(0 < r.matched <= r.end - r.start <= r.item_words == 40 and r.start >= 30 for r in rows)


def test_parts_of_long_items_and_words_put_in_or_left_out(spark):
    rnd = random.Random(2)
    sizes = [59, 400, 40, 40, 24, 59]
    items = [words(rnd, n) for n in sizes]
    a, b, c, d, e, f = items
    parts = [a[20:45], b[100:250], [*c[:13], "new", *c[13:26], "new", *c[26:]], [*d[:13], *d[14:27], *d[28:]], [*e[:12], "put", "in", *e[12:]], f[20:32]]
    docs = [(i, " ".join(words(rnd, 30) + v + words(rnd, 30))) for i, v in enumerate(parts)]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    rows = {r.doc_id: (r.item_id, r.start, r.end, r.matched, round(r.share * r.item_words)) for r in got.collect()}
    assert rows == {0: (0, 30, 55, 25, 25), 1: (1, 30, 180, 150, 150), 2: (2, 30, 72, 40, 40), 3: (3, 30, 68, 38, 38), 4: (4, 30, 56, 24, 24)}  # 12 words are too few


def test_short_items_and_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five"), (2, "one two"), (3, None), (4, ""), (5, "a b c d e f g h i")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero ONE two three four five six"), (2, "one two three four six"), (3, "x a b c d e f g h i"), (4, None), (5, "one two")], "doc_id long, text string")
    expected = {(1, 1), (3, 5)}
    assert {(r.doc_id, r.item_id) for r in D.contamination(docs, items).collect()} == expected
    monkeypatch.setattr(D, "BLOCK_BYTES", 10)
    assert {(r.doc_id, r.item_id) for r in D.contamination(docs, items).collect()} == expected
    left = D.decontaminate(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 4, 5}


def test_awkward_rows(awkward, nothing, benchmark_items):
    assert D.contamination(awkward, benchmark_items).count() == 0
    assert D.decontaminate(awkward, benchmark_items).count() == awkward.count()
    assert D.decontaminate(nothing, benchmark_items).count() == 0
    assert D.decontaminate(awkward, benchmark_items.limit(0)).count() == awkward.count()
