"""A few catalog queries against their SQL, and the entry module without the optional subpackage."""

import subprocess
import sys

import duckdb
import pytest

from webrank.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tokenize_stats", "search_full", "near_duplicates", "url_normalize_crawl", "page_weighted_tf", "keep_first_pages", "search_benchmark", "html_next_links", "html_visible_text"])
def test_query_equals_sql(spark, name):
    got = catalog.queries()[name](spark, DIR)
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "lineitem", "part"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(got.select(columns).collect()) == key(want.select(*columns).fetchall())


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, '.')\nimport __spark_entry__ as e\nassert 'search_full' in e.queries() and not [q for q in e.queries() if q.startswith('op')]\nassert set(e.oracle_sql()) <= set(e.queries())"
    root = __file__.rsplit("/tests/", 1)[0]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_links_parse_each_page_once_in_bounded_batches(spark):
    got = catalog.html_links(spark, DIR)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    want = con.sql(f"SELECT page_id, i, target, text FROM ({catalog.oracle_sql()['html_links']})").fetchall()
    assert sorted(map(tuple, got.select("page_id", "i", "target", "text").collect())) == sorted(want)
