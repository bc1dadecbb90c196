import zlib

from pyspark.sql import functions as F

from glossa.llm.sharding import assign, jump_hash, shard_documents


def jump(key, n):
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_the_published_algorithm(spark):
    keys = [*range(300), -1, -(2**63), 2**63 - 1, 2**32, 2**31, 123456789123456789]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 7, 8, 9, 50):
        assert {r.k: r.s for r in df.select("k", jump_hash(F.col("k"), n).alias("s")).collect()} == {k: jump(k, n) for k in keys}


def test_growth_moves_rows_only_into_the_new_shard(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    r = assign(assign(df, "k", 10, "a"), "k", 11, "b").agg(F.count_if(F.expr("a <> b")).alias("moved"), F.count_if(F.expr("a <> b and b <> 10")).alias("wrong")).first()
    assert r.wrong == 0 and abs(r.moved / 20000 - 1 / 11) < 0.01


def test_documents(documents, texts):
    df = shard_documents(documents, 8)
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "key", jump(r.doc_id, 8), jump(r.doc_id, 9))
    for k in range(8):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_many_equal_rows_and_nulls(spark, awkward, nothing):
    df = spark.range(70000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(awkward.select("doc_id", "text"))
    out = shard_documents(df, 8)
    assert out.count() == df.count()
    s = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 and r.d == r.n for r in s)
    assert shard_documents(nothing, 8).count() == 0
    assert shard_documents(awkward.where("text is null"), 8).select("size", "text_crc32").distinct().collect() == [(1, 0)]


def test_other_keys(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, shard int")
    assert assign(df, "k", 4).count() == 3
