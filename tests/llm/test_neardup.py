import random
import re

import pytest

from glossa.llm import neardup as N

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts: dict) -> dict:
    sets = {d: shingles(t) for d, t in texts.items()}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def compare(df, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}
    assert got == brute(texts)


def test_documents(documents, texts):
    compare(documents, texts)


def family(rnd, n, size, rate):
    base = [f"b{rnd.randint(0, 10**7)}" for _ in range(size)]
    return [" ".join(f"e{rnd.randint(0, 10**7)}" if rnd.random() < rnd.choice((0, rate / 3, rate, 2 * rate)) else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("dense", [3, 24])
def test_families_of_near_copies(spark, monkeypatch, dense):
    monkeypatch.setattr(N, "DENSE", dense)
    monkeypatch.setattr(N, "BLOCK", 16)
    rnd = random.Random(dense)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = family(rnd, 60, 80, 0.04) + family(rnd, 30, 12, 0.02) + family(rnd, 8, 300, 0.01)
    rows += [" ".join(f"u{rnd.randint(0, 10**7)}" for _ in range(60)) + " " + passage for _ in range(60)]
    rows += ["one two three", "ONE two  three", "one two", "a b c d e", "a b c d e f", ""]
    rnd.shuffle(rows)
    texts = dict(enumerate(rows))
    compare(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


def test_leaders_join_a_large_family_in_linear_work(spark, monkeypatch):
    """A family that its leader links meets no other block; outsiders of the same lists are still found exactly."""
    monkeypatch.setattr(N, "DENSE", 5)
    monkeypatch.setattr(N, "BLOCK", 8)
    seen = []
    real = N._list_links
    monkeypatch.setattr(N, "_list_links", lambda *a: seen.append(f := real(*a)) or f)
    rnd = random.Random(2)
    tight = family(rnd, 120, 200, 0.005)
    texts = dict(enumerate(tight))
    compare(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)
    assert len(seen) == 2
    seen.clear()
    base = tight[0].split()
    apart = [" ".join(base[:100] + [f"x{k}{i // 4}" for i in range(60)] + base[160:]) for k in range(6) for _ in range(2)]
    chain = [" ".join(base[: 200 - 12 * k] + [f"c{i}" for i in range(12 * k)]) for k in range(10)]
    texts = dict(enumerate(tight + apart + chain))
    compare(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


def test_boundary(spark):
    words = [f"w{i}" for i in range(200)]
    base = " ".join(words[:79])  # 75 shingles
    longer = " ".join(words[:104])  # 100 shingles: similarity 0.75 exactly
    just = " ".join(words[:105])
    texts = {1: base, 2: longer}
    compare(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)
    texts = {1: base, 2: just}
    compare(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)
    assert brute({1: base, 2: longer})[2][1] == 1 and brute({1: base, 2: just})[2][1] == 2


def test_awkward_rows(awkward, nothing):
    rows = N.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {(r.doc_id, r.component_id, r.kept) for r in rows}
    assert {(8, 1, False), (1, 1, True), (2, 2, True), (3, 3, True), (None, None, True)} <= by
    assert N.near_duplicates(nothing).count() == 0
    kept = N.keep_one(awkward)
    assert kept.schema == awkward.schema and sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 2 3 4 5 6 7 9 10 None".split())
    assert N.keep_one(nothing).count() == 0
    clash = awkward.withColumnsRenamed({"rid": "n", "key": "kept_id", "hi": "row"})
    assert N.keep_one(clash).columns == clash.columns and N.keep_one(clash).count() == kept.count()
