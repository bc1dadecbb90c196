import re

import corpus_pipeline as P
from glossa.llm import queries

from .conftest import SF
from .test_neardup import shingles


def test_stages(spark, tmp_path, texts, benchmark_items):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
            rows = docs.collect()
            seen[name] = {r.doc_id: r.text for r in rows}
            assert len(seen[name]) == len(rows) and all(r.n_chars == len(r.text) for r in rows)
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "repeated_sentences", "benchmark_leaks", "pack"]
    assert all(re.search(r"[^\W\d_]", t) for t in seen["language"].values())
    assert len(seen["language"]) == sum(bool(re.search(r"[^\W\d_]", t)) for t in texts.values())
    kept = seen["near_duplicates"]
    sets = {d: shingles(t) for d, t in kept.items()}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            assert 100 * n < 75 * (len(sets[a]) + len(sets[b]) - n)
    assert all(len(t) <= len(kept[d]) for d, t in seen["repeated_sentences"].items())
    items = [" ".join(r.text.lower().split()) for r in benchmark_items.collect()]
    clean = [" ".join(t.lower().split()) for t in seen["benchmark_leaks"].values()]
    assert not any(x in t for x in items for t in clean)
    leaked = {d for d, t in seen["repeated_sentences"].items() if any(x in " ".join(t.lower().split()) for x in items)}
    assert set(seen["repeated_sentences"]) - set(seen["benchmark_leaks"]) >= leaked
    assert {r.doc_id for r in docs.collect()} == set(seen["benchmark_leaks"])


def test_stages_on_awkward_and_empty_tables(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            if name != "pack":
                assert out.columns == docs.columns


def test_run_leaves_only_what_its_result_reads(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    P.run(spark, SF).collect()
    left = {x.name.rsplit("-", 1)[0] for x in set(shared.iterdir()) - before}
    assert left == {"pipeline-benchmark_leaks", "packing"}


def test_registered():
    assert P.ORACLE_SQL is None and "pipeline" in queries.QUERIES
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES if q.startswith("op"))
    assert numbers == list(range(1, 11))
