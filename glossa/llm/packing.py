"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

WINDOW = 4096
PIECE = 512  # the part of a document beyond whole windows is cut into pieces of so many tokens
BLOCK = 2048  # mean number of short pieces that are differenced together
RUN = 65536  # equal pieces that are dealt out at a time
STEP = 2000  # documents that are encoded together
CACHE = 2_000_000  # words and parts of words that a worker keeps, at most about 400 MB

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


# The settings of a tokenizers file under which the words of a text are encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

# Text of these characters is split here as the tokenizer's own pattern does; any other goes to it whole.
_PLAIN = re.compile("[^\t\n\r -~¡-įı-ſ]")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes, by any tokenizers file.

    Where its settings lower-case and split at white space and between letters, digits and signs, words and their
    parts are encoded once and kept; texts of other files are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.by_word = made["normalizer"] == _NORMALIZER and made["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        self.by_word &= made["post_processor"] is None and made["model"]["type"] == "BPE" and all(t["content"].startswith("<|") for t in made["added_tokens"])
        self.bare = Tokenizer.from_file(path)  # for parts that are split and in lower case already
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}  # parts of words too

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        whole = {w for w in words if w.isalpha()}
        split = [(w, (w[:-1], w[-1]) if w[-1] in ".,!" and w[:-1].isalpha() else _PARTS.findall(w)) for w in words - whole]
        new = list(whole.union(*(ps for _, ps in split)).difference(self.words))
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            e = self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            last = np.flatnonzero(self.ends[np.array(e.ids, np.int64)]) + 1
            if len(last) != len(some):  # not a vocabulary that marks the ends of words
                e = self.bare.encode(" ".join(some), add_special_tokens=False)
                last = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some)), "right")
            cut = [0, *(4 * last).tolist()]
            raw = np.array(e.ids, "<u4").tobytes()
            self.words.update(zip(some, [raw[s:t] for s, t in zip(cut, cut[1:])]))
        get = self.words.__getitem__
        self.words.update([(w, b"".join(map(get, ps))) for w, ps in split])

    def _room(self, more: int) -> None:
        """Before the cache overflows its longer words go, which are the rarer ones, and if that isn't enough all."""
        if len(self.words) + more > CACHE:
            self.words = {w: b for w, b in self.words.items() if len(w) < 8}
            if len(self.words) + more > CACHE // 2:
                self.words = {}

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """ids of each text (null: none). Distinct words of all texts are looked up once."""
        if not self.by_word:
            return [b"" if t is None else self._whole(t) for t in texts.to_pylist()]
        plain = [t is not None and not _PLAIN.search(t) and "<|" not in t for t in texts.to_pylist()]
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(plain, pa.bool_()), texts, "")))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self.words.get, words))
        holes = list(compress(range(len(found)), map(not_, found)))
        new = {words[i] for i in holes} - {""}
        if len(new) > CACHE // 4 and len(texts) > 1:
            half = len(texts) // 2
            return self.encode_all(texts.slice(0, half)) + self.encode_all(texts.slice(half))
        self._room(len(new))
        self._learn(new)
        for i in holes:
            found[i] = self.words.get(words[i], b"")  # the empty word at the edge of a text
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat = np.frombuffer(b"".join(found), "<u4")
        index = coded.indices.to_numpy()
        n = size[index]
        end = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[index] - end + n, n) + np.arange(n.sum())]
        offsets = split.offsets.to_numpy()
        cut = np.concatenate(([0], end))[offsets - offsets[0]].tolist()
        return [ids[x:y].tobytes() if ok else b"" if t is None else self._whole(t) for ok, t, x, y in zip(plain, texts.to_pylist(), cut, cut[1:])]


_ENCODERS: dict[str, Encoder] = {}


def _cutter(path: str, end_id: int, window: int, piece: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        end, collects = np.array([end_id], "<u4").tobytes(), gc.isenabled()
        gc.disable()  # nothing here makes cycles, and collections walk the caches
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, STEP):
                    part = batch.slice(lo, STEP)
                    out: list[tuple] = []
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode_all(part.column(1))):
                        ids += end
                        total = len(ids) // 4
                        whole = total - total % window
                        for s, e in [(x, x + window) for x in range(0, whole, window)] + [(x, min(x + piece, total)) for x in range(whole, total, piece)]:
                            out.append((doc_id, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), total))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            if collects:
                gc.enable()

    return cut


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """Window of each item by Karmarkar-Karp differencing into m windows.

    Every item starts as a partial partition (itself and m - 1 empty sets). The two of largest spread are merged,
    the largest set of one with the smallest of the other, until one is left. Empty sets aren't stored.
    """
    n = len(sizes)
    if m == 1 or n == 0:
        return np.zeros(n, np.int64)
    left, right = [-1] * n, [-1] * n  # sets are trees over the items
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, va, na = heapq.heappop(heap)
        _, _, vb, nb = heap[0]
        k = max(0, len(va) + len(vb) - m)
        p, q = len(va) - k, len(vb) - k
        if k:
            with_a, with_b = na[p:], nb[q:][::-1]
            made = np.arange(len(left), len(left) + k)
            left.extend(with_a.tolist())
            right.extend(with_b.tolist())
            v = np.concatenate((va[:p], va[p:] + vb[q:][::-1], vb[:q]))
            node = np.concatenate((na[:p], made, nb[:q]))
        else:
            v, node = np.concatenate((va, vb)), np.concatenate((na, nb))
        order = np.argsort(-v, kind="stable")
        v, node = v[order], node[order]
        heapq.heapreplace(heap, (-int(v[0] - (v[-1] if len(v) == m else 0)), tick, v, node))
        tick += 1
    out = np.zeros(n, np.int64)
    for w, root in enumerate(heap[0][3].tolist()):
        stack = [root]
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = w
            else:
                stack += (left[x], right[x])
    return out


def pack(sizes: np.ndarray, window: int) -> np.ndarray:
    """Window of each item: as few near-equal windows as differencing finds with none above capacity."""
    total = int(sizes.sum())
    m = max(1, -(-total // window))
    while True:
        to = differencing(sizes, m)
        over = int(np.bincount(to, weights=sizes, minlength=m).max(initial=0)) - window
        if over <= 0:
            return to
        mean = total / m
        m = max(m + 1, int(np.ceil(total / max(mean - over, 1))) if over < mean / 8 else m + 1)


def _packer(window: int):
    def place(key, pdf):
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        size = pdf["length"].to_numpy(np.int64)
        full = size == window
        to = np.zeros(len(size), np.int64)
        to[~full] = pack(size[~full], window)
        n = int(to[~full].max()) + 1 if (~full).any() else 0
        to[full] = n + np.arange(int(full.sum()))
        order = np.argsort(to, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        first = np.searchsorted(to[order], to[order], "left")
        offset = np.zeros(len(size), np.int64)
        offset[order] = before - before[first]
        pdf["sequence_id"] = (int(key[0]) << 32) + to
        pdf["offset"] = offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return place


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `window` tokens.

    A document is its token ids and end_id; null and empty texts are end_id alone, so every row has a piece.
    Whole windows of a long document are sequences by themselves; the rest is cut into pieces of at most `piece`
    tokens. Pieces fall into blocks of about BLOCK by hash, and each block is differenced into near-equal windows, in
    the order of doc_id, start and ids_crc32, so the result depends on the rows only and not on how they are dealt out.
    Repeated rows give pieces of their own, counted first and dealt to blocks by their number. doc_id may be null; an
    empty table gives no pieces; other columns are not read.
    """
    small_batches(docs.sparkSession)
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cutter(tokenizer_path, end_id, window, min(piece, window)), _PIECES)
    pieces = materialize(pieces, "packing")
    blocks = max(1, -(-pieces.where(F.col("length") < window).count() // BLOCK))
    kinds = pieces.groupBy("doc_id", "start", "length", "ids_crc32", "doc_tokens").agg(F.count(F.lit(1)).alias("copies"))
    runs = kinds.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least("copies", (F.col("run") + 1) * RUN) - 1)))
    keyed = each.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(blocks))).drop("copies", "run", "copy")
    return keyed.groupBy("block").applyInPandas(_packer(window), _PACKED)
