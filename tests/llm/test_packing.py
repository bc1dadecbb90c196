import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glossa.llm.packing import Encoder, differencing, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, tokenizer):
    """rows give every text's ids back; sequences are gapless and at most a window long."""
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    expected = {}
    for d, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        expected.setdefault(d, []).append(ids)
    for d, wanted in expected.items():
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by.pop(d))
        spans = []
        for ids in wanted:
            own = [x for x in got if x[3] == len(ids) and zlib.crc32(ids[x[0] : x[0] + x[1]].tobytes()) == x[2]]
            spans += own if len(wanted) == 1 else [min(own)] if len(own) == 1 else list(dict.fromkeys(own))
            at = 0
            for s, n, _, _ in dict.fromkeys(own):
                assert s == at
                at += n
            assert at == len(ids)
        assert len(got) >= len(set(spans))
    assert not by
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    return sum(r.length for r in rows) / (4096 * len(seqs))


def test_round_trip(documents, texts):
    rows = pack_documents(documents, PATH).collect()
    assert check(rows, list(texts.items()), Tokenizer.from_file(PATH)) > 0.95


def test_awkward_rows(awkward):
    rows = pack_documents(awkward, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in awkward.collect()], Tokenizer.from_file(PATH))
    assert len([r for r in rows if r.doc_id == 1]) == 2


def test_empty(nothing):
    assert pack_documents(nothing, PATH).count() == 0


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_differencing(m):
    rnd = random.Random(m)
    for _ in range(60):
        sizes = np.array([rnd.randint(1, 30) for _ in range(rnd.randint(1, 7))])
        to = differencing(sizes, m)
        assert len(to) == len(sizes) and set(to) <= set(range(m))
        most = np.bincount(to, weights=sizes, minlength=m).max()
        best = min(np.bincount(x, weights=sizes, minlength=m).max() for x in itertools.product(range(m), repeat=len(sizes)))
        assert best <= most <= 4 / 3 * best + 1e-9 or most <= best + sizes.min()


def test_known_partition():
    to = differencing(np.array([8, 7, 6, 5, 4]), 2)  # the differencing method's textbook example
    assert sorted(np.bincount(to, weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_capacity():
    rnd = random.Random(1)
    for _ in range(20):
        sizes = np.array([rnd.randint(1, 1024) for _ in range(400)])
        to = pack(sizes, 4096)
        load = np.bincount(to, weights=sizes)
        assert load.max() <= 4096 and load.sum() == sizes.sum()
        assert load.max() - load.min() < 400 and len(load) <= sizes.sum() / 4096 * 1.08 + 1
    assert list(pack(np.array([4096, 4096]), 4096)) in ([0, 1], [1, 0])
    assert len(pack(np.zeros(0, np.int64), 4096)) == 0


def test_encoder_equals_the_tokenizer():
    e, t = Encoder(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(2)
    letters = [chr(c) for c in range(0x20, 0x260)] + list("\t\n\r 'sdmt.,!%ΣΩ日 …é")
    samples = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    samples += ["Don't we'll I'M 'S''s", "<|endoftext|> a", "a" * 3000, "", "İstanbul ΣΑΣ ŉ ſ", "½ ² ª º"]
    for lo in range(0, len(samples), 37):
        part = samples[lo : lo + 37]
        assert e.encode_all(pa.array(part)) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in part]


def test_small_cache(monkeypatch):
    from glossa.llm import packing

    monkeypatch.setattr(packing, "CACHE", 40)
    e, t = Encoder(PATH), Tokenizer.from_file(PATH)
    for k in range(30):
        part = [f"word{k} other{k % 3} and, the {k}", "the and"]
        assert e.encode_all(pa.array(part)) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in part]


def test_other_tokenizers_are_encoded_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = Encoder(path), Tokenizer.from_file(path)
    samples = ["Don't we'll I'M", "plain words and  two spaces", "", "<|endoftext|> a", "日本語 Ünïcödé"]
    assert not e.by_word and Encoder(PATH).by_word
    assert e.encode_all(pa.array([*samples, None])) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in samples] + [b""]


def test_sequences_do_not_depend_on_partitions(spark, documents):
    docs = documents.unionAll(documents.limit(5))
    a, b = ({tuple(r): None for r in pack_documents(docs.repartition(n), PATH).collect()} for n in (2, 7))
    assert a.keys() == b.keys()


def test_collector_is_left_as_it_was(documents):
    import gc

    from glossa.llm.packing import _cutter

    assert gc.isenabled()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", None]})
    assert sum(x.num_rows for x in _cutter(PATH, 2, 4096, 512)(iter([batch]))) == 2 and gc.isenabled()
