"""Every registered query against its SQL on the smallest tables; those without SQL at least run whole."""

import math

import duckdb
import pytest

from siftline.plans.catalog import QUERIES, SQL
from siftline.session import TABLES

SF = "/root/testdata/sf0.001"
#: Row counts that queries without SQL must have: one per input row.
WHOLE = {"extract_text": "pages", "parse_pages": "pages", "robots_allowed": "pages"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    expected = rows(cursor.fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.select(*names).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_whole(spark, con, name):
    n = QUERIES[name](spark, SF).count()
    assert n > 0
    if name in WHOLE:
        assert n == con.execute(f"SELECT count(*) FROM {WHOLE[name]}").fetchone()[0]


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
