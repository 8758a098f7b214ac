"""Driver contract: entry smoke run and every query against its DuckDB SQL (sf0.001)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldspark.plans import driver
from tools.check_oracle import TABLES, canon, close, type_diffs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"data_level", "species", "name", "median", "mean", "sd", "lower",
                               "upper"}
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(driver.ORACLE_SQL) == set(driver.QUERIES)
    assert set(driver.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query_matches_oracle(spark, con, name):
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = kept().size()
    sdf = entry.queries()[name](spark, SF)
    sp = sdf.toPandas()
    assert kept().size() <= before
    rel = con.sql(entry.oracle_sql()[name])
    assert not type_diffs(sdf, rel)
    dd = rel.df()
    sc, sr = canon(sp)
    dc, dr = canon(dd)
    assert sc == dc
    assert len(sr) == len(dr)
    for a, b in zip(sr, dr):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


def test_partition_count_invariance(spark):
    """Results do not depend on the number of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = {}
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out[n] = {name: canon(entry.queries()[name](spark, SF).toPandas())
                      for name in ("summarize_draws", "locf_fill", "predicted_draws")}
        assert out["1"] == out["13"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
