"""Licence scans: a trained paragraph classifier confirmed by comparison with templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, rows_of, slices, small_batches

UNKNOWN = "unknown"
BITS = 18  # hashed features
GRAMS = 3
WINDOW, STEP = 60, 40  # longer lines are judged in windows of words
ACROSS = 15  # words between the windows of a line that run on into the next lines of its paragraph
SAMPLE = 400  # documents of least hash, whole, whose paragraphs teach the unknown class
PARAGRAPHS = 6000  # of their paragraphs (in pieces of WINDOW words), those of least hash
EPOCHS = 60
TEMPERATURES = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)
PROBABILITY = 0.5
CONFIRM = 0.5  # least share of a template's word pairs, weighted by rarity among families, that the paragraph holds

# Short notices and opening words by which public licences are named and granted.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3",
        "This work is licensed under the GNU AGPL version 3 or later",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0",
        "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License",
        "Licensed under the 3-clause BSD License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the Creative Commons Attribution License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under the Creative Commons Attribution-NonCommercial License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Released under the Creative Commons Attribution-ShareAlike License",
    ),
    "cc0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0",
        "This work is dedicated to the public domain under CC0 1.0 Universal",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL version 2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Released under the GNU LGPL version 3",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under The Unlicense",
    ),
}

_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in "\"'`()[]{}<>.,;:!?*#/|_=~"]] = True
_FOUND = "doc_id long, first_word long, n_words long, family string, probability double, template_share double"


class Paragraphs:
    """Lines (longer ones in windows), then windows that run across line breaks, and words without edge punctuation.

    A paragraph is a run of lines that are not blank. From each of its lines' first word, and every ACROSS words on, a
    window of up to WINDOW words runs on to the paragraph's end, unless the line holds all of it.
    """

    def __init__(self, texts: list[bytes]):
        w = Words([_bare(t) for t in texts])
        self.words, n = w, len(w.hash)
        lines = np.concatenate(([0], np.cumsum(w.buf == 10)))
        new = np.ones(n, bool)
        if n:
            new[1:] = (lines[w.start[1:]] > lines[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n)
        steps = np.maximum(1, -(-(last - first - WINDOW) // STEP) + 1) if n else np.zeros(0, np.int64)
        k = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        self.first = np.repeat(first, steps) + k * STEP
        self.last = np.minimum(np.repeat(last, steps), self.first + WINDOW)
        self.lines = len(self.first)  # the windows from here on run across line breaks
        if n:
            blank = np.ones(len(first), bool)
            blank[1:] = (lines[w.start[first[1:]]] > lines[w.end[first[1:] - 1]] + 1) | (w.doc[first[1:]] != w.doc[first[1:] - 1])
            head = np.flatnonzero(blank)
            end = np.append(first[head[1:]], n)[np.cumsum(blank) - 1]
            steps = -(-(last - first) // ACROSS)
            k = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
            start = np.repeat(first, steps) + k * ACROSS
            stop = np.minimum(np.repeat(end, steps), start + WINDOW)
            over = stop > np.repeat(last, steps)
            self.first, self.last = np.append(self.first, start[over]), np.append(self.last, stop[over])

    def grams(self) -> list[np.ndarray]:
        """For each n the hash of the n words from every place."""
        h = mix(self.words.hash)
        out, acc = [h], h
        for n in range(1, GRAMS):
            acc = mix(acc[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n:]) if len(acc) else acc
            out.append(acc)
        return out


def _bare(t: bytes) -> bytes:
    a = np.frombuffer(t, np.uint8)
    return np.where(_STRIP[a], np.uint8(32), a).astype(np.uint8).tobytes()


def _features(p: Paragraphs) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, feature) of every word n-gram inside a paragraph."""
    rows, cols = [], []
    for n, g in enumerate(p.grams(), 1):
        count = np.maximum(p.last - p.first - n + 1, 0)
        par = np.repeat(np.arange(len(p.first)), count)
        at = p.first[par] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rows.append(par)
        cols.append(g[at] >> np.uint64(64 - BITS))
    return np.concatenate(rows), np.concatenate(cols).astype(np.int64)


class Classifier:
    """Multinomial logistic regression on hashed word n-grams, trained by gradient descent with an L1 threshold.

    Notices are varied by dropping words and setting them among others; the unknown class gets sampled paragraphs, those that name
    licences among them unless a template confirms them, and scrambled notices. Features are the n-grams of notices; other words weigh nothing. A temperature calibrates the
    probabilities: it is fitted on templates of which no variant was seen in training, and on held-back paragraphs;
    then all examples are trained on.
    """

    def __init__(self, background: list[bytes], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.families = [UNKNOWN, *sorted(TEMPLATES)]
        self.template = [[_pairs(t.encode()) for t in TEMPLATES.get(f, ())] for f in self.families]
        families_with: dict[int, int] = {}
        for ts in self.template:
            for h in set().union(*map(set, ts)) if ts else ():
                families_with[h] = families_with.get(h, 0) + 1
        self.rarity = {h: 1.0 / k for h, k in families_with.items()}
        background = [x for x in background if not self._confirmed(x)]
        filler = [w for t in background for w in t.split()] or [b"text"]
        examples: list[tuple[bytes, int]] = []
        bare: list[bytes] = []  # notices without words around them: their n-grams are the features
        held: list[bool] = []
        for y, name in enumerate(self.families[1:], 1):
            back = int(rng.integers(len(TEMPLATES[name]))) if len(TEMPLATES[name]) > 2 else -1
            for i, t in enumerate(TEMPLATES[name]):
                words = t.encode().split()
                for k in range(60):
                    v = list(words)
                    if k % 3 and len(v) > 8:
                        v = [w for w in v if rng.random() > 0.08] or v
                    bare.append(b" ".join(v))
                    # alone, among a few other words, in more of them, or in a whole window
                    room = max(0, WINDOW - len(v))
                    more = (0, int(rng.integers(0, 4)), int(rng.integers(0, room + 1)), room)[k // 3 % 4]
                    before = int(rng.integers(0, more + 1))
                    around = [filler[i] for i in rng.integers(len(filler), size=more)]
                    v = around[:before] + v + around[before:]
                    examples.append((b" ".join(v), y))
                    held.append(i == back)
        public = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.encode().split()})
        for _ in range(1500):  # words of licences without their order say nothing
            examples.append((b" ".join(public[i] for i in rng.integers(len(public), size=int(rng.integers(1, 6)))) + b" " + b" ".join(filler[i] for i in rng.integers(len(filler), size=int(rng.integers(2, 12)))), 0))
        examples += [(x, 0) for x in background]
        held += (rng.random(len(examples) - len(held)) < 0.25).tolist()
        self._train(examples, np.array(held), np.unique(_features(Paragraphs(bare))[1]))

    def _confirmed(self, paragraph: bytes) -> bool:
        own = set(_pairs(paragraph))
        return bool(own & self.rarity.keys()) and any(self._share(t, own) >= CONFIRM for ts in self.template for t in ts)

    def _train(self, examples: list[tuple[bytes, int]], held: np.ndarray, used: np.ndarray) -> None:
        y = np.array([c for _, c in examples])
        p = Paragraphs([t.replace(b"\n", b" ") for t, _ in examples])
        doc = p.words.doc[p.first]
        y, held, (row, col) = y[doc], held[doc], _features(p)
        known = np.isin(col, used)
        row, col = row[known], np.searchsorted(used, col[known])
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(y))))
        order = np.argsort(row, kind="stable")
        row, col = row[order], col[order]
        w, bias = self._fit(row, col, y, scale, ~held, len(used))
        z = (self._sum(w, row, col, len(y)) * scale[:, None] + bias)[held]
        losses = [(-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[held]], 1e-12)).mean(), t) for t in TEMPERATURES] if held.any() else [(0, 1.0)]
        self.temperature = min(losses)[1]
        w, self.bias = self._fit(row, col, y, scale, np.ones(len(y), bool), len(used))
        self.weights = w
        self.slot = np.full(1 << BITS, -1, np.int32)
        self.slot[used] = np.arange(len(used))

    def _fit(self, row: np.ndarray, col: np.ndarray, y: np.ndarray, scale: np.ndarray, chosen: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights and biases from the chosen examples, each class weighing the same."""
        own = chosen[row]
        at = np.cumsum(chosen) - 1
        row, col, y, scale = at[row[own]], col[own], y[chosen], scale[chosen]
        n, c = len(y), len(self.families)
        weight = 1.0 / np.maximum(1, np.bincount(y, minlength=c))[y]
        weight /= weight.sum()
        w, bias = np.zeros((used, c)), np.zeros(c)
        square, target = np.full((used, c), 1e-8), np.eye(c)[y]
        for _ in range(EPOCHS):
            z = self._sum(w, row, col, n) * scale[:, None] + bias
            q = _softmax(z) - target
            q *= weight[:, None]
            g = np.zeros_like(w)
            d = q * scale[:, None]
            for k in range(c):
                g[:, k] = np.bincount(col, weights=d[row, k], minlength=used)
            square += g * g
            w -= 0.5 * g / np.sqrt(square)
            w = np.sign(w) * np.maximum(np.abs(w) - 2e-3, 0)
            bias -= 5.0 * q.sum(0)
        return w, bias

    @staticmethod
    def _sum(w: np.ndarray, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, w.shape[1]))
        for k in range(w.shape[1]):
            out[:, k] = np.bincount(row, weights=w[col, k], minlength=n)
        return out

    def scan(self, texts: list[bytes]) -> list[tuple]:
        """(text, first word, words, family, probability, template share) of confirmed paragraphs."""
        p = Paragraphs(texts)
        if not len(p.first):
            return []
        hits = []
        for n, g in enumerate(p.grams(), 1):
            slot = self.slot[(g >> np.uint64(64 - BITS)).astype(np.int64)]
            at = np.flatnonzero(slot >= 0)
            hits.append((at, slot[at], np.full(len(at), n)))
        at, slot, n = (np.concatenate(x) for x in zip(*hits))
        order = np.argsort(at, kind="stable")
        at, slot, n = at[order], slot[order], n[order]
        lo, hi = np.searchsorted(at, p.first), np.searchsorted(at, p.last)
        maybe = np.flatnonzero(hi > lo)
        if not len(maybe):
            return []
        count = hi[maybe] - lo[maybe]
        par = np.repeat(np.arange(len(maybe)), count)
        k = np.repeat(lo[maybe], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        inside = at[k] + n[k] <= p.last[maybe][par]
        z = self._sum(self.weights, par[inside], slot[k[inside]], len(maybe))
        size = np.bincount(par[inside], minlength=len(maybe))
        q = _softmax((z / np.sqrt(np.maximum(size, 1))[:, None] + self.bias) / self.temperature)
        best = q.argmax(1)
        pair = p.grams()[1]
        out = []
        taken = np.zeros(len(p.words.hash) + 1, bool)
        for i in np.flatnonzero((best > 0) & (q.max(1) >= PROBABILITY)):  # few paragraphs
            a, b = int(p.first[maybe[i]]), int(p.last[maybe[i]])
            across = maybe[i] >= p.lines  # after all lines: what a line or an earlier window has shown counts no more
            pairs = pair[a : b - 1]
            own = set((pairs[~(taken[a : b - 1] & taken[a + 1 : b])] if across else pairs).tolist())
            share = max(self._share(t, own) for t in self.template[best[i]])
            if share >= CONFIRM:
                taken[a:b] = True
                d = int(p.words.doc[a])
                out.append((d, a - int(p.words.first[d]), b - a, self.families[best[i]], float(q[i, best[i]]), share))
        return out

    def _share(self, template: tuple[int, ...], own: set[int]) -> float:
        total = sum(self.rarity[h] for h in template)
        return sum(self.rarity[h] for h in template if h in own) / total if total else 0.0


def _pairs(t: bytes) -> tuple[int, ...]:
    return tuple(dict.fromkeys(Paragraphs([t.replace(b"\n", b" ")]).grams()[1].tolist()))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _scanner(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            rows = rows_of(batch)
            for part, texts in slices(rows, 1):
                if found := m.scan(texts):
                    cols = list(zip(*found))
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
                    cols[0] = [part[d][0] for d in cols[0]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return scan


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (piece): its lines in pieces of WINDOW words."""
    for batch in batches:
        for t in batch.column(0).to_pylist():
            words = [x.split() for x in t.encode("utf-8", "surrogatepass").split(b"\n")]
            out = [b" ".join(x[i : i + WINDOW]) for x in words for i in range(0, len(x), WINDOW)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["piece"])


def train(docs: DataFrame) -> Classifier:
    """A classifier whose unknown class is taught by paragraphs of SAMPLE documents.

    They are those of least hash of doc_id and text; rows whose hash of doc_id lies above twice the share that is needed
    are left out first, so one scan reads few texts. Of all their paragraphs the driver gets PARAGRAPHS, those of least
    hash. Paragraphs that name a licence are taught as unknown too, unless a template confirms them.
    """
    text = F.col("text").cast("string")
    share = min(1.0, 2 * SAMPLE / max(1, docs.count()))
    pool = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= int(share * (1 << 40))).where(text.isNotNull())
    few = pool.select(text.alias("text"), F.xxhash64("doc_id", text).alias("h")).dropDuplicates(["h"]).orderBy("h").limit(SAMPLE)
    pieces = few.select("text").mapInArrow(_pieces, "piece binary").distinct().orderBy(F.xxhash64("piece"), "piece").limit(PARAGRAPHS)
    return Classifier([bytes(r[0]) for r in pieces.collect()])


def scan_licenses(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """A row for every paragraph of every document that is taken for a licence notice.

    doc_id, first_word and n_words (words between white space and edge punctuation), family, probability (calibrated),
    template_share (best share of a template's rarity-weighted word pairs found in the paragraph). A prediction that no
    template of its family confirms with a share of CONFIRM counts as unknown. Each line is judged, longer ones in
    overlapping windows, and so are windows across the line breaks of a paragraph (lines up to a blank one), which
    count by the words that no line has shown to be a notice. Null and empty texts give no row, nor do
    paragraphs judged unknown; very long texts are read whole. Repeated rows give their rows again, a null doc_id rows
    with a null one; of equally likely families the first by name is given. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanner(shared), _FOUND)
