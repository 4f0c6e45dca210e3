"""The registered queries agree with their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from optiloom.plans import catalog, oracles

SF = "/root/testdata/sf0.001"


def rows(table):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("part", "supplier", "lineitem", "orders", "events", "embeddings"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    assert rows(df.select(*names).collect()) == rows(db.sql(f"select {', '.join(names)} from ({oracles.SQL[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["detail_table", "colormap", "cluster_stats"])
def test_query_covers_all_rows(spark, name):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("part", "lineitem", "embeddings"):
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalog.queries()[name](spark, folder)
    names = sorted(df.columns)
    got = rows(df.select(*names).collect())
    assert got == rows(db.sql(f"select {', '.join(names)} from ({oracles.SQL[name]})").fetchall())
    source = {"cluster_stats": "select 64 * count(distinct label) from embeddings"}.get(name, "select count(*) from part")
    assert len(got) == db.sql(source).fetchall()[0][0]


def test_elbow_uses_all_coordinates(spark):
    assert [r.k for r in catalog.queries()["elbow"](spark, SF).orderBy("k").collect()] == list(range(2, 11))
