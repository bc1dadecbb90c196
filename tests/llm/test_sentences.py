import random
import re

from glossa.llm.sentences import CUT, LEAST, LONGEST, PIECE, SENTENCES, dedup_sentences

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(data: dict, every: bool = False) -> dict:
    seen: dict[tuple, list] = {}
    cut = {}
    for d in sorted(data):
        b = data[d]
        ws = [(m.start(), m.end(), bytes(c + 32 if 65 <= c <= 90 else c for c in m.group())) for m in WORD.finditer(b)]
        starts, last = [], 0
        for i, (s, _, _) in enumerate(ws):
            if i == 0 or b[ws[i - 1][1] - 1 : ws[i - 1][1]] in (b".", b"!", b"?") or b"\n" in b[ws[i - 1][1] : s]:
                starts.append(i)
                last = i
            elif i - last >= LONGEST and ws[i][2][-1] % CUT == 0 or (i - last) % PIECE == 0:
                starts.append(i)
        edge = starts + [len(ws)]
        runs = set()
        for i, s in enumerate(starts):
            if every:
                runs |= {(s, edge[j]) for j in range(i + SENTENCES, len(edge)) if edge[j] - s >= LEAST}
            else:
                runs |= {(s, edge[j]) for j in range(i + SENTENCES, len(edge)) if edge[j] - s >= LEAST and (j == i + SENTENCES or edge[j - 1] - s < LEAST or j - i == SENTENCES)}
                runs |= {(edge[j], edge[i + 1]) for j in range(i + 2 - SENTENCES) if edge[i + 1] - edge[j] >= LEAST and (j == i + 1 - SENTENCES or edge[i + 1] - edge[j + 1] < LEAST)}
        for s, e in runs:
            seen.setdefault(tuple(w for _, _, w in ws[s:e]), []).append((d, s, e))
        cut[d] = (ws, set())
    for places in seen.values():
        for d, s, e in sorted(places)[1:]:
            cut[d][1].update(range(s, e))
    out = {}
    for d, (ws, gone) in cut.items():
        at = [s for s, _, _ in ws] + [len(data[d])]
        kept = data[d][: at[0]] + b"".join(data[d][at[i] : at[i + 1]] for i in range(len(ws)) if i not in gone)
        out[d] = (kept.decode(), len(gone))
    return out


def test_documents(documents, texts):
    got = {r.doc_id: (r.text, r.n_words_removed) for r in dedup_sentences(documents).collect()}
    assert got == brute({d: t.encode() for d, t in texts.items()})


def test_passages(spark):
    rnd = random.Random(4)
    sentence = lambda: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(2, 30))) + "."
    passage = " ".join(sentence() for _ in range(8))
    rows = {i: " ".join([sentence() for _ in range(5)] + ([passage] if i % 2 else []) + [sentence() for _ in range(5)]) for i in range(20)}
    rows[30] = passage + " " + passage
    plain = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(70))  # no sentence ends, in the middle of sentences
    rows[40], rows[41] = (" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n)) + f" {plain} and so on" for n in (5, 9))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows.items()], "doc_id long, text string, n_sentences_removed string")
    out = {r.doc_id: r for r in dedup_sentences(df).collect()}
    assert {d: (r.text, r.n_words_removed) for d, r in out.items()} == brute({d: t.encode() for d, t in rows.items()}, every=True)
    assert out[1].text == rows[1] and out[0].text == rows[0] and passage not in out[3].text
    assert out[40].n_words_removed == 0 and out[41].n_words_removed > 30
    assert out[3].n_sentences_removed >= 8 and out[2].n_sentences_removed == 0


def test_every_run_counts(spark):
    """The last short sentences of a repeated passage go too: a longer run covers them."""
    rnd = random.Random(8)
    sentence = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n)) + "."
    passage = [sentence(n) for n in (10, 10, 10, 2, 3, 1)]
    rows = {i: " ".join([sentence(9), sentence(9), *passage, sentence(9), sentence(12)]) for i in range(4)}
    rows |= {10 + i: " ".join(sentence(rnd.randint(1, 12)) for _ in range(rnd.randint(3, 20))) + " " + " ".join(passage[rnd.randint(0, 2) :][: rnd.randint(3, 6)]) for i in range(20)}
    out = {r.doc_id: (r.text, r.n_words_removed) for r in dedup_sentences(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert out == brute({d: t.encode() for d, t in rows.items()}, every=True)
    assert out[1][1] == 36 and not any(x in out[1][0] for x in passage)


def test_awkward_rows(awkward, nothing):
    out = dedup_sentences(awkward)
    assert set(out.columns) == {*awkward.columns, "n_sentences_removed"} and out.count() == awkward.count()
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append((r.text, r.n_words_removed))
    assert by[2] == [(None, 0)] and by[3] == [("", 0)] and by[4] == [(" \n\t ", 0)]
    assert by[8][0][1] == 27 and [n for _, n in by[1]] == [0, 0]  # equal rows are one place
    assert by[None][0][1] == 0 and by[6][0][1] > 0
    assert dedup_sentences(nothing).count() == 0
