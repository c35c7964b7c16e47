"""Every query with a statement gives the statement's rows."""

import duckdb
import pytest

from sablefold.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canon(df, columns):
    return sorted(str(tuple(None if v != v else v for v in row)) for row in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got, sorted(got.columns)) == canon(want, sorted(got.columns))


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0


def test_whole_lineitem(spark, db, sf_dir):
    """The queries over boxes see all orders and demote high findings."""
    got = QUERIES["guard_oversized"](spark, sf_dir)
    assert got.count() == db.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    assert got.where("doc_id % 2 = 1").count() and got.where("conf_rank = 2").count()
    high = db.sql("SELECT count(*) FROM lineitem WHERE l_suppkey % 3 = 2 AND 20 + l_quantity * 3 > 125").fetchall()[0][0]
    low = db.sql("SELECT count(*) FROM lineitem WHERE l_suppkey % 3 < 2 AND 20 + l_quantity * 3 > 125").fetchall()[0][0]
    assert high and got.where("oversized and conf_rank = 0").count() == got.where("oversized").count() == high + low
    assert not any("l_orderkey %" in sql or "r < 2" in sql for sql in ORACLES.values())
