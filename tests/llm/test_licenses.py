import re

import numpy as np
import pytest

from glossa.llm import licenses as L
from glossa.llm.licenses import TEMPLATES, Classifier, scan_licenses, train

CUE = re.compile("licen[sc]e|copyright|GNU|Creative Commons", re.I)


@pytest.fixture(scope="module")
def model(documents):
    return train(documents)


def test_templates_are_recognised(model):
    for family, notices in TEMPLATES.items():
        for t in notices:
            found = model.scan([f"Some words before.\n{t}\nand after".encode()])
            assert [f[3] for f in found] == [family], t


def test_variants(model):
    cases = {
        b"Licensed under CC BY-NC 3.0.": "cc-by-nc",
        b"  * this file is released under the mit license, see below": "mit",
        b"Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        b"LICENSED UNDER THE APACHE LICENSE, VERSION 2.0": "apache",
    }
    for text, family in cases.items():
        assert [f[3] for f in model.scan([text])] == [family]


def test_other_text_is_unknown(model):
    assert model.scan([b"The license of the software was general and public.", b"published under water by the foundation", b"", b"source and forms"]) == []


def test_documents(documents, texts, model):
    rows = scan_licenses(documents, model).collect()
    found = {r.doc_id for r in rows}
    assert found == {d for d, t in texts.items() if t and CUE.search(t)}
    assert all(0.5 <= r.probability <= 1 and r.template_share >= 0.5 for r in rows)


def brute(model, text):
    """The rows of one text, window by window and gram by gram, from the definition."""
    m64 = (1 << 64) - 1

    def mixed(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & m64
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & m64
        return h ^ h >> 31

    strip = bytes(32 if chr(c) in "\"'`()[]{}<>.,;:!?*#/|_=~" else c for c in range(256))
    lines, hashes = [], {}
    for x in text.encode().translate(strip).split(b"\n"):
        lines.append([w for w in re.split(rb"[\x20\x09-\x0D]+", x) if w])
        for w in lines[-1]:
            hashes.setdefault(w, mixed(int(L.Words([w]).hash[0])))
    words = [w for x in lines for w in x]
    cut = [0]
    for x in lines:
        cut.append(cut[-1] + len(x))
    windows, across = [], []
    for k, x in enumerate(lines):
        a, b = cut[k], cut[k + 1]
        if not x:
            continue
        windows += [(i, min(b, i + L.WINDOW)) for i in range(a, b, L.STEP) if i == a or i - L.STEP + L.WINDOW < b]
        end = next((cut[j] for j in range(k + 1, len(lines)) if not lines[j]), len(words))
        across += [(i, min(end, i + L.WINDOW)) for i in range(a, b, L.ACROSS) if min(end, i + L.WINDOW) > b]
    out, taken = [], set()

    def grams(i, j, n):
        for s in range(i, j - n + 1):
            h = hashes[words[s]]
            for k in range(1, n):
                h = mixed((h * 0x9E3779B97F4A7C15 + hashes[words[s + k]]) & m64)
            yield s, h

    for far, (i, j) in [(0, w) for w in windows] + [(1, w) for w in across]:
        z, seen = np.zeros(len(model.families)), 0
        for n in range(1, L.GRAMS + 1):
            for _, h in grams(i, j, n):
                if (slot := model.slot[h >> 64 - L.BITS]) >= 0:
                    z, seen = z + model.weights[slot], seen + 1
        if not seen:
            continue
        q = np.exp((z / np.sqrt(seen) + model.bias) / model.temperature)
        q /= q.sum()
        best = int(q.argmax())
        if best == 0 or q[best] < L.PROBABILITY:
            continue
        own = {h for s, h in grams(i, j, 2) if not far or s not in taken or s + 1 not in taken}
        share = max(sum(model.rarity[h] for h in t if h in own) / sum(model.rarity[h] for h in t) for t in model.template[best])
        if share >= L.CONFIRM:
            taken |= set(range(i, j))
            out.append((i, j - i, model.families[best], round(float(q[best]), 9), round(share, 9)))
    return sorted(out)


def test_scan_equals_the_definition(model, texts):
    notices = [t for ts in TEMPLATES.values() for t in ts]
    some = [t for d, t in sorted(texts.items()) if t and (CUE.search(t) or d % 9 == 0) and len(t) < 6000]
    some += [MIT, BSD + "\n\n" + GPL, "word " * 90 + " ".join(notices[:4]) + " word" * 70, "\n".join(notices), "one\n\n\ntwo  three\n " + ISC]
    assert len(some) > 15
    for t in some:
        got = sorted((f[1], f[2], f[3], round(f[4], 9), round(f[5], 9)) for f in model.scan([t.encode()]))
        want = brute(model, t)
        assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3:] for x in got], [x[3:] for x in want], atol=1e-8)


def test_paragraphs_that_name_licences_teach_the_unknown_class(spark):
    hard = ["The license plate of the car was covered with mud", "His driving licence expired in the general public"] * 3
    rows = [(i, f"{hard[i % 6]} number {i}\nReleased under the MIT License\nand other words {i}") for i in range(200)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(model.scan([h.encode()]) == [] for h in hard)
    assert [f[3] for f in model.scan([b"Released under the MIT License"])] == ["mit"]


def test_long_lines_are_judged_in_windows(model):
    line = b"word " * 500 + b"Released under the MIT License. " + b"word " * 500
    assert {f[3] for f in model.scan([line])} == {"mit"}


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
ISC = """Copyright (c) 2020, Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""


@pytest.mark.parametrize("family, notice", [("mit", MIT), ("isc", ISC), ("bsd", BSD), ("gpl", GPL)])
def test_notices_wrapped_over_lines(model, family, notice):
    one = lambda text: {f[3] for f in model.scan([text.encode()])}
    assert one(notice) == {family}
    assert one("".join(f" * {x}\n" for x in notice.splitlines())) == {family}
    assert one("A line of other text that stands before the notice itself\n" + notice + "and one more line of text that follows\n") == {family}
    assert one(notice.replace("\n", "\r\n")) == {family}
    assert one("\n\n".join(x for t in notice.split() for x in (t, ""))) == set()  # words of their own paragraphs


def test_awkward_rows(awkward, nothing):
    assert scan_licenses(awkward).count() == 0
    assert scan_licenses(nothing, Classifier([])).count() == 0
    assert scan_licenses(nothing).count() == 0
