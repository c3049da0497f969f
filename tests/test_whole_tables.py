"""Queries take whole tables, beyond the first thousands of rows."""

import duckdb
import pytest

from foliate.plans import catalog
from tests.test_oracle import plain

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["anc08_words_in_rectangle", "anc09_line_boxes", "win05_gaps", "win09_dense_windows", "str17_markdown_table", "jn07_reported_ids", "str01_escape_like"])
def test_rows_of_larger_tables(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    df = catalog.QUERIES[name](spark, SF)
    order = [names.index(c) for c in df.columns]
    assert sorted(plain(r) for r in df.collect()) == sorted(plain(r[i] for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", ["lay01_gutters", "lay02_lines"])
def test_layout_of_all_orders(spark, name):
    pages = {r.page for r in catalog.QUERIES[name](spark, SF).select("page").distinct().collect()}
    orders = {r[0] for r in duckdb.sql(f"SELECT DISTINCT l_orderkey FROM '{SF}/lineitem.parquet'").fetchall()}
    assert max(pages) >= 4000 and (pages == orders or name == "lay01_gutters")


def test_histories_are_not_collected(spark, tmp_path):
    """Unknown values count as in the SQL, and no list of a user's events is made."""
    name = "flt20_history_predicates"
    rows = [(1, "purchase", None), (1, "view", 1.0), (2, "error", 2.0), (2, None, 3.0), (3, "purchase", 51.0), (3, "purchase", None)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"file:{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, f"file:{tmp_path}")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(catalog.ORACLES[name]).fetchall())
    assert "collect_list" not in df._jdf.queryExecution().toString()
