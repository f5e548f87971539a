"""Queries of the site, review, guidance and book plans against their SQL, on small tables."""

import pytest

from assaylake.plans import books, guidance, reviews, site, texts

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "lineitem", "documents", "customer", "benchmark", "conversations")
QUERIES = site.QUERIES | reviews.QUERIES | guidance.QUERIES | books.QUERIES | {"rate_limit": texts.rate_limit}
SQL = site.SQL | reviews.SQL | guidance.SQL | books.SQL | {"rate_limit": texts.SQL["rate_limit"]}


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    wanted = con.execute(SQL[name])
    columns = sorted(x[0] for x in wanted.description)
    at = [x[0] for x in wanted.description]
    want = ordered(tuple(r[at.index(c)] for c in columns) for r in wanted.fetchall())
    frame = QUERIES[name](spark, DIR)
    assert sorted(frame.columns) == columns
    got = ordered(tuple(r) for r in frame.select(*columns).collect())
    assert got == want
