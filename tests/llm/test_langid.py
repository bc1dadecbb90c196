import math
import zlib

import numpy as np

from glossa.llm.langid import Model, identify, keep_identified

from .conftest import SF


def brute(model_texts, text, order=3):
    """PPM with escape method C and exclusions, from the definition."""
    out = {}
    for lang, sample in model_texts.items():
        counts = {}
        for t in sample:
            s = b"\n" * order + t.lower()
            for i in range(order, len(s)):
                for k in range(order + 1):
                    c = counts.setdefault(s[i - k : i], {})
                    c[s[i]] = c.get(s[i], 0) + 1
        s, bits = b"\n" * order + text.lower(), 0.0
        for i in range(order, len(s)):
            excluded, p = set(), 1.0
            for k in range(order, -1, -1):
                c = {x: n for x, n in counts.get(s[i - k : i], {}).items() if x not in excluded}
                if not c:
                    continue
                total = sum(c.values()) + len(c)
                if s[i] in c:
                    p *= c[s[i]] / total
                    break
                p *= len(c) / total
                excluded |= set(c)
            else:
                p /= 230 - len(excluded)
            bits -= math.log2(p)
        out[lang] = bits
    return out


def test_code_lengths_equal_the_definition(monkeypatch):
    from glossa.llm import langid

    monkeypatch.setattr(langid, "LEAST", 1)
    sample = {"a": [b"abracadabra and banana", b"abba"], "b": [b"the cat sat on the mat", b"mathematics"]}
    m = Model.of_texts(sample)
    for text in (b"abra the cat", b"zzz 123", b"a", b"Mathematics and Banana", "日本語 é".encode()):
        want = brute(sample, text)
        got = dict(zip(m.langs, m.bits([text])[0]))
        for k in want:
            assert abs(got[k] - want[k]) < 1e-3
    assert np.argmin(m.bits([b"abracadabra"])[0]) == 0 and np.argmin(m.bits([b"the mat"])[0]) == 1


def test_probabilities_sum_to_one():
    import random

    rnd = random.Random(1)
    many = {k: ["".join(chr(rnd.randint(lo, lo + 300)) for _ in range(400)).encode() for _ in range(5)] for k, lo in (("zh", 0x4E00), ("ko", 0xAC00), ("el", 0x370), ("ar", 0x600))}
    for sample in ({"x": [b"hello hello yellow"], "y": [b"guten tag gute nacht"]}, many):
        m = Model.of_texts(sample)
        p = 2.0 ** -m.cost.reshape(-1, m.n, len(sample)).astype(float)
        total = p[:, 1:].sum(1) + p[:, 0] * (230 - (m.n - 1))  # symbol 0 stands for each byte without its own
        assert np.allclose(total, 1, atol=1e-4)


def test_scripts_and_code_lengths_of_many_bytes(monkeypatch):
    from glossa.llm import langid

    monkeypatch.setattr(langid, "LEAST", 1)
    sample = {"zh": ["语言模型的训练数据".encode() * 3], "ko": ["언어 모델 훈련 데이터".encode() * 3], "el": ["γλώσσα και μοντέλο".encode() * 3], "raw": [bytes(range(256))]}
    m = Model.of_texts(sample)
    assert m.n == 231
    for k, text in (("zh", "数据语言"), ("ko", "데이터 언어"), ("el", "και γλώσσα")):
        want = brute(sample, text.encode())
        got = dict(zip(m.langs, m.bits([text.encode()])[0]))
        assert min(got, key=got.get) == k and all(abs(got[x] - want[x]) < 1e-3 for x in want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(awkward, nothing):
    rows = identify(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[2] == by[3] == by[4] == by[5] == [("und", 0.0)]
    assert by[1][0][0] == by[8][0][0] == "en" and by[6][0][0] == "de"
    assert identify(nothing).count() == 0
    # nothing to learn from: everything is undetermined
    assert {r.lang_pred for r in identify(awkward.where("lang is null")).collect()} == {"und"}
    kept = keep_identified(awkward)
    assert kept.columns == awkward.columns and kept.schema == awkward.schema
    assert {r.doc_id for r in kept.collect()} >= {1, 6, 8} and not kept.where("text is null or text = ''").count()
    assert keep_identified(nothing).count() == 0


def test_folds_and_labels_are_not_read(spark, documents):
    a = {r.doc_id: r.lang_pred for r in identify(documents).collect()}
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    b = identify(documents.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))).collect()
    assert {r.doc_id: r.lang_pred for r in b} == a
