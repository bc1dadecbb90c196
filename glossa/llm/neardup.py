"""Near duplicates: bottom-k sketches from one hash function, inverted lists, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, components, discard, fresh, materialize, rows_of, shingles, slices, small_batches

WORDS = 5
PERCENT = 75  # least similarity in hundredths
K = 32  # retained values of a sketch
DENSE = 24  # longer inverted lists go the way of hot values
HOT_LEAST = 9  # hot values that a document must retain to be compared through hot values alone
BLOCK = 512  # documents, and
BLOCK_VALUES = 1 << 20  # shingles, of which a block of a hot list holds about so many at most
SLACK = 0.42  # the estimate must reach the least similarity less this much: over five standard errors at K values

_least_hot = f"cast(least({HOT_LEAST}, ceil(n_shingles * {PERCENT} / 100)) as int)"
_SKETCH = "doc_id long, n_shingles long, digest binary, sketch array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        rows = rows_of(batch)
        for part, texts in slices(rows, 1):
            w = Words(texts)
            h, d = shingles(w, WORDS)
            cut = np.searchsorted(d, np.arange(len(texts) + 1))
            out = ([], [], [], [])
            for i, row in enumerate(part):
                own = np.unique(h[cut[i] : cut[i + 1]])
                out[0].append(row[0])
                out[1].append(len(own))
                out[2].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                out[3].append(own[:K].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sketch"])


def _estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from the least K values of the union of two bottom-k sketches."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    union = np.union1d(a, b)[:K]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union) if len(union) else 0.0


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb) to (a, b, est) of those whose estimate is not hopeless."""
    for batch in batches:
        sa, sb = batch.column(2), batch.column(3)
        est = np.array([_estimate(np.array(x.values), np.array(y.values)) for x, y in zip(sa, sb)])
        keep = np.flatnonzero(est >= PERCENT / 100 - SLACK)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(est[keep])], names=["a", "b", "est"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ta, tb) to (a, b) of those whose full shingle sets are similar enough."""
    for batch in batches:
        a, b = [], []
        rows = rows_of(batch)
        flat = ((x[0], x[1], t) for x in rows for t in x[2:])
        hold = None
        for part, texts in slices(flat, 2):
            h, d = shingles(Words(texts), WORDS)
            cut = np.searchsorted(d, np.arange(len(texts) + 1))
            for i, row in enumerate(part):
                own = np.unique(h[cut[i] : cut[i + 1]])
                if hold is None:
                    hold = own
                    continue
                both = len(np.intersect1d(hold, own, assume_unique=True))
                if 100 * both >= PERCENT * (len(hold) + len(own) - both):
                    a.append(row[0])
                    b.append(row[1])
                hold = None
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = rows_of(batch)
        for part, texts in slices(rows, 1):
            h, d = shingles(Words(texts), WORDS)
            cut = np.searchsorted(d, np.arange(len(texts) + 1))
            sets = [np.unique(h[cut[i] : cut[i + 1]]).view(np.int64) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shared"])


def _overlaps(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of the intersections of the first `cut` sets (rows) with the others (columns), or with themselves
    if there are no others. Frequent values are counted by matrix products, the others value by value."""
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    rows = cut
    cols = len(sets) - cut or cut
    off = cut if len(sets) > cut else 0
    out = np.zeros((rows, cols), np.float32)
    if not len(doc):
        return out
    _, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(inv, kind="stable")
    doc, inv = doc[order], inv[order]
    often = np.flatnonzero(df > 16)
    for lo in range(0, len(often), 4096):
        slot = np.full(len(df), -1)
        slot[often[lo : lo + 4096]] = np.arange(len(often[lo : lo + 4096]))
        at = slot[inv]
        some = at >= 0
        m = np.zeros((len(sets), len(often[lo : lo + 4096])), np.float32)
        m[doc[some], at[some]] = 1
        out += m[:cut] @ m[off:].T
    start = np.concatenate(([0], np.cumsum(df)))
    for f in range(2, 17):
        own = np.flatnonzero(df == f)
        for lo in range(0, len(own), 4096):
            d = doc[start[own[lo : lo + 4096], None] + np.arange(f)]
            x, y = np.repeat(d, f, 1).ravel(), np.tile(d, (1, f)).ravel()
            ok = (x < cut) & (y >= off)
            np.add.at(out, (x[ok], y[ok] - off), 1)
    return out


def _block_links(key, pdf):
    """A spanning forest of the exact links between two blocks of a hot list: no more edges than documents."""
    import pandas as pd

    left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
    both = pd.concat((left, right))
    ids, n = both.doc_id.to_numpy(), both.n_shingles.to_numpy(np.float64)
    cut, off = len(left), len(left) if len(right) else 0
    both_n = _overlaps([np.asarray(x, np.int64) for x in both.shared], cut)
    union = n[:cut, None] + n[None, off:] - both_n
    link = np.zeros((len(ids), len(ids)), bool)
    link[:cut, off:] = 100 * both_n.astype(np.float64) >= PERCENT * union
    link |= link.T
    new, out = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        stack = [root] if new[root] else []
        new[root] = False
        while stack:
            x = stack.pop()
            to = np.flatnonzero(link[x] & new)
            new[to] = False
            stack += to.tolist()
            out += [(min(ids[x], ids[y]), max(ids[x], ids[y])) for y in to]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _ask(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets confirm the link."""
    p = pairs.select("a", "b")
    asked = p.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = texts.join(asked, "id", "left_semi")
    return (
        p.join(few.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(few.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
        .mapInArrow(_verified, "a long, b long")
    )


def _labels(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, component) of the documents that are linked: components of links and of those that labels stand for.

    Links that lie inside a component change nothing; only the components that others join are solved anew.
    """
    if labels is None:
        return components(links)
    side = lambda s: labels.select(F.col("id").alias(s), F.col("component").alias(f"c{s}"))
    e = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    e = materialize(e.distinct(), "neardup-joins")
    if e.isEmpty():
        discard(e)
        return labels
    more = components(e)
    moved = labels.join(more.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    out = materialize(moved.unionByName(more.join(labels.select("id"), "id", "left_anti")), "neardup-labels")
    discard(e, more, labels)
    return out


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    side = lambda s: labels.select(F.col("id").alias(s), F.col("component").alias(f"c{s}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _confirm(cand: DataFrame, texts: DataFrame) -> DataFrame:
    """Components of the links among candidate pairs (a, b, est).

    First the best partner of each document is asked, then whatever still lies between different components. A pair
    inside one component can change nothing and is never read.
    """
    up = cand.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
    down = cand.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a"))
    found = materialize(_ask(up.select("a", "b").unionByName(down.select("a", "b")).distinct(), texts), "neardup-links")
    labels = _labels(found)
    more = materialize(_ask(_between(cand.select("a", "b"), labels), texts), "neardup-links")
    labels = _labels(more, labels)
    discard(found, more)
    return labels


def _dense_links(dense: DataFrame, base: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the links between documents whose sketches mostly hold values of long lists (families of near copies).

    Their full sets are read. A document with more than a quarter of values that no other of them has can't be
    linked to any. The others are compared in the lists of their hot values: first with one leader of their list, which
    is linear in the documents and joins most of a family; then block by block, where blocks of one component are
    never compared with each other, in the lists of so many values that no pair with HOT_LEAST in common is missed.
    Each block pair returns a spanning forest of its exact links.
    """
    sets = materialize(base.join(dense.select("doc_id"), "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id long, shared array<long>"), "neardup-sets")
    value = sets.select("doc_id", F.explode("shared").alias("s"))
    known = value.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("s")
    shared = value.join(known, "s", "left_semi").groupBy("doc_id").agg(F.collect_list("s").alias("shared"))
    live = materialize(dense.join(shared, "doc_id").where(f"100 * size(shared) >= {PERCENT} * n_shingles"), "neardup-live")
    for k in (1, 2):
        labels = _labels(found := _leader_links(live, labels, k), labels)
        discard(found)
    for depth in (1, K):
        labels = _labels(found := _list_links(live, labels, depth), labels)
        discard(found)
    discard(sets, live)
    return labels


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _leader_links(live: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Links of each document with the leader of its k-th hot value's list, the one with most hot values."""
    rows = _labelled(live.where(F.size("hot") >= k).select("doc_id", "n_shingles", F.size("hot").alias("n_hot"), F.element_at("hot", k).alias("v")), labels)
    lead = rows.groupBy("v").agg(F.max_by(F.struct("doc_id", "component", "n_shingles"), F.struct("n_hot", F.xxhash64("doc_id"))).alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    lead = materialize(lead.select("v", "lead.*").toDF("v", "b", "cb", "nb"), "neardup-leaders")  # sized: small ones are broadcast
    pairs = rows.join(lead, "v").where("component <> cb").select("doc_id", F.col("n_shingles").alias("na"), "b", "nb")
    pairs = pairs.where("100 * least(na, nb) >= {0} * greatest(na, nb)".format(PERCENT))
    own, other = live.select("doc_id", F.col("shared").alias("sa")), live.select(F.col("doc_id").alias("b"), F.col("shared").alias("sb"))
    led = materialize(other.join(lead.select("b").distinct(), "b", "left_semi"), "neardup-leaders")
    both = pairs.join(own, "doc_id").join(led, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    found = materialize(both.where(f"100 * n >= {PERCENT} * (na + nb - n)").select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")), "neardup-links")
    discard(lead, led)
    return found


def _list_links(live: DataFrame, labels: DataFrame, depth: int) -> DataFrame:
    """Links between components in the lists of the first `depth` hot values of each document, block by block.

    A component that fills blocks of a list by itself has blocks of its own, which aren't compared with each other; the
    documents of smaller ones share blocks. So a family that leaders have joined meets its outsiders only.
    """
    keys = live.select("doc_id", F.size("shared").alias("size"), F.explode(F.expr(f"slice(hot, 1, least({depth}, size(hot) - {_least_hot} + 1))")).alias("v"))
    keys = _labelled(keys, labels)
    parts = keys.groupBy("v", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    parts = parts.withColumn("need", F.greatest(F.col("c") / BLOCK, F.col("s") / BLOCK_VALUES))
    large = F.col("need") >= 1
    lists = parts.groupBy("v").agg(
        F.count(F.lit(1)).alias("kinds"), F.coalesce(F.ceil(F.sum(F.when(~large, F.col("need")))), F.lit(0)).cast("int").alias("mixed"), F.coalesce(F.sum(F.when(large, F.ceil("need"))), F.lit(0)).cast("int").alias("pure")
    )
    split = materialize(lists.where("kinds > 1").drop("kinds"), "neardup-split")
    own = W.partitionBy("v").orderBy("component").rowsBetween(W.unboundedPreceding, -1)
    few = parts.where(large).join(split, "v")  # each fills a block of the list, so they are few
    few = few.withColumn("n", F.ceil("need").cast("int")).withColumn("from", F.coalesce(F.sum("n").over(own), F.lit(0)).cast("int") + F.col("mixed"))
    few = materialize(few.select("v", "component", "n", "from"), "neardup-pure")
    rows = keys.select("v", "doc_id", "component").join(split, "v").join(few, ["v", "component"], "left")
    h = F.xxhash64("doc_id")
    rows = rows.withColumn("own", F.when(F.col("n").isNull(), F.pmod(h, F.greatest("mixed", F.lit(1)))).otherwise(F.col("from") + F.pmod(h, F.col("n"))).cast("int"))
    # the blocks to meet: all, but of a pure block those of its component only
    every = F.sequence(F.lit(0), F.col("mixed") + F.col("pure") - 1)
    meet = F.when(F.col("n").isNull(), every).otherwise(F.filter(every, lambda o: (o < F.col("from")) | (o >= F.col("from") + F.col("n"))))
    rows = rows.withColumn("o", F.explode(meet)).select("v", "doc_id", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"))
    rows = rows.join(live.select("doc_id", "n_shingles", "shared"), "doc_id")
    found = materialize(rows.groupBy("v", "i", "j").applyInPandas(_block_links, "a long, b long").distinct(), "neardup-links")
    discard(split, few)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    A document's set are its distinct runs of WORDS words (A-Z lower-cased, cut at white space), or its one run of all
    words if it has fewer; null and empty texts have an empty set and are linked with nothing. Two documents are linked
    if PERCENT of the union of their sets is common; component_id is the least doc_id that is reachable.
    doc_id is the row's identity: rows that repeat a doc_id give one row each; a null doc_id gives
    a row of its own that is kept, with null component_id. An empty table gives an empty table.
    Documents of equal shingle sets form one class by a 128-bit digest before anything is compared.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = materialize(base.mapInArrow(_sketches, _SKETCH), "neardup-sketch")
    classes = sk.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = materialize(classes, "neardup-reps")
    posts = reps.select(F.col("rep").alias("doc_id"), F.col("n").alias("n_shingles"), F.explode("sketch").alias("v"))
    lists = posts.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = materialize(lists, "neardup-values")  # a join of two scans can be split where a value is frequent
    listed = materialize(posts.join(lists, "v"), "neardup-lists")
    discard(lists)
    sketch_of = reps.select(F.col("rep").alias("id"), "sketch")

    def with_estimate(pairs: DataFrame) -> DataFrame:
        s = lambda side: sketch_of.select(F.col("id").alias(side), F.col("sketch").alias(f"s{side}"))
        return pairs.join(s("a"), "a").join(s("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_estimated, "a long, b long, est double")

    fits = lambda x, y: f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})"
    rare = listed.where(F.col("df") <= DENSE).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_shingles"))).alias("m"))
    rare = rare.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    rare = rare.where(fits("x.n_shingles", "y.n_shingles")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).where("a < b").distinct()

    texts = base.withColumnRenamed("doc_id", "id")
    cand = materialize(with_estimate(rare), "neardup-pairs")
    labels = _confirm(cand, texts)

    hot = listed.where(F.col("df") > DENSE)
    dense = hot.groupBy("doc_id").agg(F.first("n_shingles").alias("n_shingles"), F.sort_array(F.collect_list("v")).alias("hot")).where(f"size(hot) >= {_least_hot}")
    dense = materialize(dense, "neardup-dense")
    if not dense.isEmpty():
        labels = _dense_links(dense, base, labels)
    discard(listed, cand, dense)
    named = reps.select("digest", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sk.join(named.withColumn("some", F.lit(True)), (sk.digest == named.digest) & (sk.n_shingles > 0), "left")
    return out.select(sk.doc_id, sk.n_shingles, F.coalesce("component", sk.doc_id).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, the one of least doc_id; all columns stay.

    Rows without doc_id stay. Of rows that share a doc_id, one stays: the one of least text.
    """
    n, kept_id, row = (fresh(docs, x) for x in ("n", "kept_id", "row"))
    found = near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias(n))
    ids = materialize(found.withColumnRenamed("doc_id", kept_id), "neardup-kept")
    kept = docs.join(ids, F.col("doc_id").cast("long") == F.col(kept_id))
    names = docs.columns
    single = kept.where(F.col(n) == 1).select(*names)
    by = W.partitionBy("doc_id").orderBy("text")
    several = kept.where(F.col(n) > 1).withColumn(row, F.row_number().over(by)).where(F.col(row) == 1).select(*names)
    return single.unionByName(several).unionByName(docs.where(F.col("doc_id").isNull()))
