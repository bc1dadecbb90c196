import random

import pytest

from glossa.functions.bytestrings import successor
from glossa.functions.config import DictConfig
from glossa.plans.dictionary import Dictionary
from tests.trie_model import Model

WORDS = "a app apple application apply banana band bank can cat dog door test testing trie".split()
WEIGHT_IDS = "a app banana band bank test trie can cat dog door testing apple application apply".split()
LABEL_IDS = "a app banana band bank can cat dog door test trie testing apple application apply".split()


def queries(spark, *values):
    return spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "query_id long, query binary")


def ids(d):
    return {bytes(r.key): r.key_id for r in d.keys.collect()}


@pytest.fixture(scope="module")
def words(spark):
    return Dictionary.from_rows(spark, WORDS).cache()


def test_golden_ids(spark, words):
    assert ids(words) == {w.encode(): i for i, w in enumerate(WEIGHT_IDS)}
    assert ids(Dictionary.from_rows(spark, WORDS, DictConfig(order="label"))) == {w.encode(): i for i, w in enumerate(LABEL_IDS)}


def test_golden_dump_and_statistics(words):
    dump = [bytes(r.key).decode() for r in words.dump().orderBy("dfs_rank").collect()]
    assert dump == "a app apple application apply banana band bank test testing trie can cat dog door".split()
    assert (words.size(), words.num_nodes(), words.empty()) == (15, 21, False)
    assert (words.num_tries, words.tail_mode, words.node_order, words.cache_level) == (3, "text", "weight", "normal")
    assert words.total_size() > 0
    row = words.statistics().first()
    assert (row.num_keys, row.num_nodes, row.max_depth) == (15, 21, 4)


def test_reverse_lookup(spark, words):
    n = spark.createDataFrame([(i,) for i in [*range(15), 15, -1]], "key_id long")
    got = {r.key_id: r.key and bytes(r.key).decode() for r in words.reverse_lookup(n).collect()}
    assert got == {**dict(enumerate(WEIGHT_IDS)), 15: None, -1: None}
    assert words.reverse_lookup(n, "inner").count() == 15
    with pytest.raises(Exception, match="out of range"):
        words.reverse_lookup(n, "strict").collect()
    with pytest.raises(ValueError):
        words.reverse_lookup(n, "other")


def test_lookup_contains_missing(spark, words):
    q = queries(spark, b"apple", b"appl", b"", b"zebra", None, b"testing")
    assert [r.key_id for r in words.lookup(q).orderBy("query_id").collect()] == [12, -1, -1, -1, -1, 11]
    assert sorted(r.query_id for r in words.contains(q).collect()) == [0, 5]
    assert sorted(r.query_id for r in words.missing(q).collect()) == [1, 2, 3, 4]


def test_command_line_words(spark):
    d = Dictionary.from_rows(spark, "a app apple application apply banana band".split())
    assert d.num_nodes() == 10
    q = queries(spark, b"application", b"ap", b"bandit")
    cps = [(r.query_id, bytes(r.key).decode(), r.key_id, r.n_found) for r in d.common_prefix_search(q).orderBy("query_id", "ordinal").collect()]
    assert cps == [(0, "a", 0, 3), (0, "app", 1, 3), (0, "application", 5, 3), (1, "a", 0, 1), (2, "band", 3, 1)]
    found = [(bytes(r.key).decode(), r.key_id, r.n_found) for r in d.predictive_search(q).where("query_id = 1").orderBy("ordinal").collect()]
    assert found == [("app", 1, 4), ("apple", 4, 4), ("application", 5, 4), ("apply", 6, 4)]


def test_limits_counts_and_misses(spark, words):
    q = queries(spark, b"", b"b", b"banan", b"x", None)
    top = words.predictive_search(q, limit=2, keep_missing=True).orderBy("query_id", "ordinal").collect()
    assert [(r.query_id, r.key and bytes(r.key).decode(), r.n_found) for r in top] == [(0, "a", 15), (0, "app", 15), (1, "banana", 3), (1, "band", 3), (2, "banana", 1), (3, None, 0), (4, None, 0)]
    assert [r.n_found for r in words.predictive_count(q).orderBy("query_id").collect()] == [15, 3, 1, 0, 0]
    long = words.longest_prefix(queries(spark, b"applications", b"b")).collect()
    assert [(r.query_id, bytes(r.key)) for r in long] == [(0, b"application")]


def test_repeated_queries_and_null_ids_are_answered_each(spark, words):
    rows = [(1, b"apples"), (1, b"apples"), (None, b"apples"), (None, b"zebra"), (2, None), (2, b"apples")]
    q = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in rows], "query_id long, query binary")
    text = lambda v: None if v is None else bytes(v).decode()
    found = [(r.query_id, text(r.query), r.ordinal, text(r.key), r.n_found) for r in words.common_prefix_search(q, keep_missing=True).collect()]
    hits = [(0, "a", 3), (1, "app", 3), (2, "apple", 3)]
    want = [(i, "apples", *h) for i in (1, 1, None, 2) for h in hits] + [(None, "zebra", None, None, 0), (2, None, None, None, 0)]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert words.common_prefix_search(q).count() == 12
    assert [text(r.key) for r in words.longest_prefix(q).collect()] == ["apple"] * 4
    p = spark.createDataFrame([(1, bytearray(b"ban")), (1, bytearray(b"ban")), (None, bytearray(b"ban")), (None, bytearray(b"x")), (None, None)], "query_id long, query binary")
    found = [(r.query_id, text(r.query), r.ordinal, text(r.key), r.n_found) for r in words.predictive_search(p, keep_missing=True).collect()]
    want = [(i, "ban", k, w, 3) for i in (1, 1, None) for k, w in enumerate(("banana", "band", "bank"))] + [(None, "x", None, None, 0), (None, None, None, None, 0)]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_long_keys_cost_linear_bytes(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(1)
    stem = bytes(rnd.choices(b"abc", k=19_000))
    keys = [stem + b"x" * 1000, stem + b"xy", stem[:500] + b"z", b"short", stem[:257], stem[:256]]
    d, model = Dictionary.from_rows(spark, keys), Model([(k, 1.0) for k in keys])
    assert ids(d) == model.ids and d.long_keys
    assert d.locus.agg(F.sum(F.octet_length("prefix"))).first()[0] < 2 * 257 * 256
    probes = [stem[:n] for n in (0, 10, 255, 256, 257, 258, 499, 501, 19_000, 18_999)] + [stem + b"xxx", stem + b"y", stem[:500] + b"z", stem[:300] + b"q"]
    found = {}
    for r in d.predictive_search(queries(spark, *probes)).orderBy("ordinal").collect():
        found.setdefault(bytes(r.query), []).append(bytes(r.key))
    assert found == {p: v for p in probes if (v := [k for k in model.preorder if k.startswith(p)])}
    counts = {bytes(r.query): r.n_found for r in d.predictive_count(queries(spark, *probes)).collect()}
    assert counts == {p: sum(k.startswith(p) for k in model.preorder) for p in probes}


def test_tables_of_a_build_are_deleted(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    d = Dictionary.from_rows(spark, WORDS)
    assert {x.name.rsplit("-", 1)[0] for x in set(shared.iterdir()) - before} == {"dictionary-keys", "dictionary-nodes", "locus"}
    other = Dictionary.from_rows(spark, ["b"])
    a, b = d.swap(other)
    assert (a.size(), b.size()) == (1, 15)
    d.clear()
    other.clear()
    assert set(shared.iterdir()) == before


def test_starts_with_is_a_range(words, tmp_path):
    stored = words.save(str(tmp_path / "d"))
    df = stored.starts_with(b"app")
    assert sorted(bytes(r.key) for r in df.collect()) == [b"app", b"apple", b"application", b"apply"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert successor(b"a\xff\xff") == b"b" and successor(b"\xff") is None and successor(b"") is None
    assert stored.starts_with(b"").count() == 15


@pytest.mark.parametrize("order", ["weight", "label"])
@pytest.mark.parametrize("seed", range(5))
def test_random_sets_equal_the_model(spark, order, seed):
    rnd = random.Random(seed)
    alphabet = [b"ab", b"\x00\x01\xff", "aéñ".encode(), bytes(range(256)), b"abc"][seed]
    keys = [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 7))) for _ in range(60)]
    keys += rnd.sample(keys, 15)
    pairs = [(k, rnd.choice([0.0, -1.0, 0.5, 1.0, 2.0, 8.0])) for k in keys]
    model, d = Model(pairs, order), Dictionary.from_rows(spark, pairs, DictConfig(order=order))
    assert ids(d) == model.ids
    assert [bytes(r.key) for r in d.dump().orderBy("dfs_rank").collect()] == model.preorder
    nodes = d.nodes.collect()
    assert {bytes(r.path) for r in nodes} == model.nodes
    assert {bytes(r.path): bytes(r.parent) for r in nodes if r.parent is not None} == model.parent
    probes = sorted({k[:i] for k in keys for i in range(len(k) + 1)} | {b"zzz", b"\xfe\xfe"})[:60]
    found: dict[bytes, list[bytes]] = {}
    for r in d.predictive_search(queries(spark, *probes)).orderBy("ordinal").collect():
        found.setdefault(bytes(r.query), []).append(bytes(r.key))
    assert found == {p: v for p in probes if (v := [k for k in model.preorder if k.startswith(p)])}
    longer = [k + b"a" for k in probes]
    prefixes: dict[bytes, list[bytes]] = {}
    for r in d.common_prefix_search(queries(spark, *longer)).orderBy("ordinal").collect():
        prefixes.setdefault(bytes(r.query), []).append(bytes(r.key))
    assert prefixes == {p: v for p in longer if (v := sorted((k for k in model.keys if p.startswith(k)), key=len))}


def test_empty_set_and_empty_key(spark):
    none = Dictionary.from_rows(spark, [])
    assert none.empty() and none.size() == 0 and none.num_nodes() == 1
    assert none.predictive_count(queries(spark, b"", b"a")).where("n_found > 0").isEmpty()
    assert none.common_prefix_search(queries(spark, b"a")).isEmpty()
    d = Dictionary.from_rows(spark, [b"", b"a", b"a"])
    assert ids(d) == {b"": 0, b"a": 1} and d.num_nodes() == 2
    assert [r.key_id for r in d.common_prefix_search(queries(spark, b"ab")).orderBy("ordinal").collect()] == [0, 1]


def test_ranged_ranks_equal_the_single_window(spark, monkeypatch):
    from glossa.plans import stage

    keys = [f"k{i * i % 101}/{i % 7}" for i in range(150)]
    plain = ids(Dictionary.from_rows(spark, keys))
    monkeypatch.setattr(stage, "SMALL", 10)
    assert ids(Dictionary.from_rows(spark, keys)) == plain == Model([(k.encode(), 1.0) for k in keys]).ids


def test_counts_take_only_prefixes_of_asked_lengths(spark, words):
    from glossa.operators.search import reach

    q = queries(spark, b"ap", b"zz", b"b", None, b"x" * 300)
    found = {bytes(r.query): r.dfs_hi - r.dfs_lo + 1 for r in reach(q, words.keys, words.locus, words.long_keys).collect()}
    assert found == {p.encode(): sum(w.startswith(p) for w in WORDS) for p in {w[:n] for w in WORDS for n in (1, 2)}}


def test_a_build_keeps_one_row_a_node(spark, monkeypatch):
    from glossa.operators import build
    from glossa.plans import stage

    rnd, rows = random.Random(3), {}
    keys = [b"a" * n for n in range(1, 400)] + [b"a" * n + bytes(rnd.choices(b"abc", k=5)) for n in rnd.sample(range(400), 60)]
    pairs = [(k, rnd.choice([0.0, -1.0, 0.5, 1.0, 2.0])) for k in keys]

    def counted(df, name):
        out = stage.staged(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(build, "staged", counted)
    for small in (stage.SMALL, 10):  # nested keys in one range, and across ranges
        monkeypatch.setattr(stage, "SMALL", small)
        for order in ("weight", "label"):
            model, d = Model(pairs, order), Dictionary.from_rows(spark, pairs, DictConfig(order=order))
            assert max(rows.values()) <= len(model.nodes)
            assert ids(d) == model.ids and [bytes(r.key) for r in d.dump().orderBy("dfs_rank").collect()] == model.preorder
            nodes = {bytes(r.path): r for r in d.nodes.collect()}
            assert {p: bytes(r.parent) for p, r in nodes.items() if r.parent is not None} == model.parent
            for p, r in nodes.items():
                assert (r.subtree_weight, r.dfs_hi - r.dfs_lo + 1) == (sum(w for k, w in pairs if k.startswith(p)), sum(k.startswith(p) for k in model.preorder))
                assert model.preorder[r.dfs_lo].startswith(p) and len(r.rank_path) == 2 * r.depth


def test_not_built(spark):
    with pytest.raises(ValueError):
        Dictionary.build(None)
    with pytest.raises(ValueError):
        Dictionary.from_rows(spark, ["a"]).io_size()


def test_configuration_flags():
    assert DictConfig.from_flags(0) == DictConfig()
    for c in (DictConfig(), DictConfig("label", 7, "binary", "huge"), DictConfig("weight", 127, "text", "tiny")):
        assert DictConfig.from_flags(c.flags()) == c
    for bad in (-1, 1 << 20, 0x30000, 0x3000, 0x180):
        with pytest.raises(ValueError):
            DictConfig.from_flags(bad)
    for bad in ({"order": "x"}, {"num_tries": 0}, {"num_tries": 128}, {"tail": "x"}, {"cache": "x"}):
        with pytest.raises(ValueError):
            DictConfig(**bad)
