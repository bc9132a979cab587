"""Queries over pages whose URLs repeat, against their SQL: the given small tables have none."""

import duckdb
import pytest

from siftline.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Pages in pairs and threes of one URL, of one request or of several, and one without a host."""
    out = tmp_path_factory.mktemp("repeated")
    url = lambda i: "/relative" if i == 4 else f"https://h{i % 50 % 7}.example/p?utm_source=x{i}"
    rows = [(i, url(i), f"<html><title>Page {i}</title></html>") for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{out}/pages.parquet")
    return str(out)


def compare(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall(), key=str)
    assert sorted(map(tuple, QUERIES[name](spark, folder).select(*names).collect()), key=str) == want
    return want


def test_a_render_of_several_is_taken_once(spark, folder):
    rows = compare(spark, folder, "auto_render_merge")
    assert len(rows) == 199 and any(title.startswith("rendered") for _, title, _ in rows)


def test_variants_of_all_appearances(spark, folder):
    rows = compare(spark, folder, "rrf_metadata")
    assert any(r[3].count("original") > 1 for r in rows)
