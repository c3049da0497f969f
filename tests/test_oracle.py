"""Every registered query that SQL can express gives the rows of its SQL."""

import duckdb
import pytest

from foliate.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def plain(row):
    return tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_of_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    found = oracle.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted(plain(r) for r in df.collect()) == sorted(plain(r[i] for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
