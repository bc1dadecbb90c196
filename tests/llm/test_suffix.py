import hashlib
import random

import numpy as np
import pytest

from glossa.llm import induced, suffix
from glossa.llm.suffix import LENGTH, remove_repeats, repeats


def suffix_array(t, cap, limit):
    order, lcp = (np.concatenate(x) for x in zip(*induced.suffix_order(t, int(t.max()) + 1, cap, induced.Scratch(), limit).down()))
    return order, np.append(0, lcp[:-1])


def repeated_windows(segments, limit=None):
    hits = [np.zeros(max(0, len(s) - LENGTH + 1), bool) for s in segments]
    rows = ([(k,)] for k in range(len(segments)))
    for tags, x, y in repeats(zip(rows, ([s] for s in segments)), limit):
        for (k,), a, b in zip(tags.tolist(), x, y):
            hits[k][a:b] = True
    return hits


@pytest.mark.parametrize("small", [0, 1 << 10])
@pytest.mark.parametrize("limit", [3, 10, 1 << 20])
def test_suffix_array_and_common_prefixes(limit, small, monkeypatch):
    monkeypatch.setattr(induced, "SMALL", small)
    rnd = random.Random(limit)
    for trial in range(150):
        body = [rnd.randint(1, rnd.choice([1, 2, 3, 20])) for _ in range(rnd.randint(1, 60))]
        t = body * (3 if trial % 3 == 0 else 1) + [0]
        cap = rnd.choice([5, 200])
        sa, lcp = suffix_array(np.array(t, np.uint16), cap, limit)
        expected = sorted(range(len(t)), key=lambda i: t[i:])
        assert sa.tolist() == expected
        for a, b, v in zip(expected, expected[1:], lcp[1:]):
            n = 0
            while n < min(len(t) - a, len(t) - b) and t[a + n] == t[b + n]:
                n += 1
            assert v == min(n, cap)


def brute(data: dict) -> dict:
    seen, twice = set(), set()
    for b in data.values():
        for i in range(len(b) - LENGTH + 1):
            w = b[i : i + LENGTH]
            (twice if w in seen else seen).add(w)
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if b[i : i + LENGTH] in twice:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def compare(df, data):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}
    assert got == brute(data)


def test_documents(documents, texts):
    compare(remove_repeats(documents), {d: (t or "").encode() for d, t in texts.items()})


def test_planted_repeats(spark):
    rnd = random.Random(5)
    line = lambda n: "".join(rnd.choice("abcde fgh") for _ in range(n))
    p, q, edge = line(450), line(260), line(200)
    rows = {i: line(rnd.randint(0, 400)) + (p[: rnd.randint(150, 450)] if i % 3 == 0 else "") + line(50) + (q if i % 4 == 0 else "") for i in range(40)}
    rows |= {50: edge + "x" + edge, 51: edge[:199] + "y", 52: "ab" * 400, 53: "z" * 201, 54: "z" * 199, 55: "é" * 150, 56: "", 57: line(199)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    compare(remove_repeats(df), {d: t.encode() for d, t in rows.items()})


def test_awkward_rows(awkward, nothing):
    got = {}
    for r in remove_repeats(awkward).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    assert got[2] == got[3] == [(0, 0, 0)] and got[1] == [(135, 0, 0)] * 2
    assert got[6] == [(300000, 300000, 1)] and got[7] == [(50000, 50000, 1)]
    assert remove_repeats(nothing).count() == 0


def test_equal_rows_lose_everything(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(300)) + "end"
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeats(df).collect()] == [303] * 3


def test_windows_of_segments():
    a = bytes(range(32, 127)) * 3
    hits = repeated_windows([a[:250], a[10:260], b"q" * 210])
    assert [h.tolist() for h in hits] == [[False] * 10 + [True] * 41, [True] * 41 + [False] * 10, [True] * 11]


def test_a_shard_ten_times_the_limit_spills_and_recurses():
    rnd = random.Random(9)
    words = [bytes(rnd.choices(b"abcdefgh", k=rnd.randint(2, 9))) for _ in range(300)]
    segments = [b" ".join(rnd.choices(words, k=60))[:280] for _ in range(160)]
    segments += [segments[k][20:] + b"tail" * 5 for k in range(0, 160, 7)]
    limit = sum(map(len, segments)) // 40
    scratch = induced.Scratch()
    hits = [np.zeros(len(s) - LENGTH + 1, bool) for s in segments]
    for tags, x, y in repeats((([(k,)], [s]) for k, s in enumerate(segments)), limit, scratch):
        for (k,), a, b in zip(tags.tolist(), x, y):
            hits[k][a:b] = True
    seen, twice = set(), set()
    for s in segments:
        for i in range(len(s) - LENGTH + 1):
            w = s[i : i + LENGTH]
            (twice if w in seen else seen).add(w)
    assert [h.tolist() for h in hits] == [[s[i : i + LENGTH] in twice for i in range(len(s) - LENGTH + 1)] for s in segments]
    assert scratch.spilled > 10 * limit and scratch.levels >= 3


def test_long_repetitive_texts():
    for t in (b"a" * 5000, b"ab" * 4000, b"abc" * 700 + b"abd" * 700, bytes(range(256)) * 20, b"zyx" * 2000):
        hits = repeated_windows([t], 500)[0]
        seen = {}
        for i in range(len(t) - LENGTH + 1):
            seen.setdefault(t[i : i + LENGTH], []).append(i)
        want = np.zeros(len(hits), bool)
        for at in seen.values():
            want[at] = len(at) > 1
        assert hits.tolist() == want.tolist()


def test_hot_keys_are_split_and_shards_shared(spark, monkeypatch):
    """A core of 150 bytes in many surroundings: its key is split, or all its segments meet in one shard; alike results."""
    rnd = random.Random(12)
    line = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    core, around = line(150), [(line(90), line(90)) for _ in range(25)]
    rows = {i: rnd.choice(around)[0] + core + rnd.choice(around)[1] + line(30) for i in range(120)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for hot, shard, limit in ((1, 1 << 20, 1 << 17), (10**9, 4000, 300)):
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "SHARD", shard)
        monkeypatch.setattr(suffix, "LIMIT", limit)
        compare(remove_repeats(df), {d: t.encode() for d, t in rows.items()})
