"""Queries against their SQL over a few made-up rows that the driver's tables don't hold, or only at larger sizes."""

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def by_both(spark, tmp_path, name, **tables):
    """Rows of the query and of its SQL over ``tables`` (rows, schema), sorted."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    wanted = con.execute(entry.oracle_sql()[name])
    at = [x[0] for x in wanted.description]
    want = [tuple(r[at.index(c)] for c in sorted(at)) for r in wanted.fetchall()]
    frame = entry.queries()[name](spark, str(tmp_path))
    assert sorted(frame.columns) == sorted(at)
    key = lambda r: [(x is None, str(x)) for x in r]
    return sorted((tuple(r) for r in frame.select(*sorted(at)).collect()), key=key), sorted(want, key=key)


#: Words that go on with other letters, and letters that another case of theirs meets.
TURNS = ["Onené de", "éThin a", "Ouland rulesé", "thandé Onen", "é\u00e7of it", "SRC1é", "\u017fRC1 v2 x", "chEape\u017ft", "Andé", "And_", "of_ of", "_Onen", "rule\u017f of Ouland", None, ""]


@pytest.mark.parametrize("name", ["question_scope", "scope_reasons"])
def test_scope_reads_words_as_sql_does(spark, tmp_path, name):
    turns = [(i, t, "user", text) for i, text in enumerate(TURNS) for t in range(6)]
    got, want = by_both(spark, tmp_path, name, conversations=(turns, "conv_id long, turn long, role string, text string"))
    assert got == want
