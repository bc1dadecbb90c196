import os

import duckdb
import pytest

from glossa import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(values):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    found = db.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(db.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({catalog.ORACLES[name]})").fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["stream_common_prefix", "stream_lookup", "stream_predictive_count"])
def test_streams_read_tables_of_several_files(spark, tmp_path, name):
    for t in ("pages", "nation", "customer", "part"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    df, plain = (catalog.QUERIES[name](spark, d) for d in (str(tmp_path), SF))
    found = rows(df.collect())
    assert found and found == rows(plain.collect())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_no_theta_joins(spark):
    d = catalog.dictionary(spark, SF, "urls")
    for df in (catalog.predictive_search(spark, SF), catalog.common_prefix_search(spark, SF), d.lookup(catalog._pages(spark, SF))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
