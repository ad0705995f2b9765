"""Queries against their SQL on tables that the driver's small ones don't hold: repeated addresses, nulls, keys beyond a million."""

from collections import Counter

import duckdb
import pytest

from folioscope.plans import catalog

PAGES = [(1, "http://a.org/x", ""), (2, "http://a.org/x", ""), (3, "http://a.org/x", ""), (6, "https://www.A.org/x/", ""), (9, None, ""), (10, None, ""), (None, "http://b.org", "")]
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
LINKS = [(1, None, 3, 1, 2.0, "R", "F"), (1, 7, 4, 2, 2.0, "N", "O"), (1, 7, 4, 2, 1.0, "A", None), (None, 8, 5, 1, 3.0, "R", "F"), (2, None, 5, 1, 3.0, None, "O"), (3, 5, 5, 3, 1.0, "R", None)]
CRAWL = [(1, 1, 5, 1, 1.0, "R", "F"), (2, 1_000_005, 7, 1, 1.0, "R", "F"), (3, 1_000_007, 5, 1, 1.0, "R", "F"), (4, 1_000_007, 5, 2, 1.0, "R", "F"), (5, 9, 7, 1, 1.0, "R", "F")]


@pytest.mark.parametrize(("name", "table", "rows", "schema"), [("c12_archive_titles", "pages", PAGES, "page_id long, url string, html string"), ("d10_paper_links", "lineitem", LINKS, LINES), ("n1_crawl", "lineitem", CRAWL, LINES)])
def test_odd_table(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    spark.range(1, 3).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(expected) and expected


#: Rows of a paper that share their place, in one file and in two, and quantities that round to and from one place.
TIES = [(1, 7, 4, 2, 2.0, "N", "O"), (1, 7, 5, 2, 2.0, "A", "F"), (2, 7, 4, 1, 2.7, "N", "F"), (2, 7, 4, 1, 2.2, "N", "O"), (3, 7, 4, 1, 2.5, "N", "O"), (3, 7, 4, 1, 1.5, "N", "F"), (4, 7, 5, 1, 1.0, "R", None), (4, 7, 5, 1, 1.0, "R", "O"), (5, 100_007, 4, 1, 2.0, "R", "O"), (5, 7, 4, 2, 2.0, "R", "F")]
TIES_BEHIND = [(1, 7, 4, 2, 2.0, "N", "A"), (4, 7, 5, 1, 1.0, "R", "F"), (6, 1, 1, 1, 1.0, "R", "O")]


def test_d10_rows_of_one_place(spark, tmp_path):
    for i, rows in enumerate((TIES, TIES_BEHIND)):
        spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / str(i)).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    got = catalog.QUERIES["d10_paper_links"](spark, str(tmp_path))
    con = duckdb.connect(config={"threads": 1})  # of one place, the row that the table has first
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL['d10_paper_links']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(expected) and expected
