import re
from collections import defaultdict

import pytest

from assaylake.plans import monitoring

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.01"


def by_sql(name):
    con = duckdb.connect()
    for table in ("events", "customer"):
        con.execute(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    return sorted(con.execute(monitoring.SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["round_change", "compact_id_match"])
def test_against_sql(spark, name):
    frame = monitoring.QUERIES[name](spark, DIR)
    rows = sorted(tuple(r) for r in frame.collect())
    assert rows and rows == by_sql(name)


def test_every_analyte_and_customer(spark):
    assert {r.analyte for r in monitoring.round_change(spark, DIR).collect()} == {"click", "view", "purchase", "error", "signup"}
    names = {r.c_name for r in spark.read.parquet(f"{DIR}/customer.parquet").collect()}
    assert {r.coc_id for r in monitoring.compact_id_match(spark, DIR).collect()} == names
    assert {r.coc_id for r in monitoring.id_suggestions(spark, DIR).collect()} == names


def brute(rows):
    """One lab id after another takes the only open custody id that agrees, if there is just one."""
    compact = lambda x: re.sub("[^0-9a-z]", "", x.lower())
    lab, coc = {}, defaultdict(list)
    for key, name, nation in sorted(rows):
        lab.setdefault(name.upper().replace("#", " - "), (nation, key))
    for key, name, nation in sorted(rows):
        if name not in lab:
            coc[compact(name), nation].append(name)
    names, out = {name for _, name, _ in rows}, set()
    for mine, (nation, _) in sorted(lab.items(), key=lambda x: x[1][1]):
        fit = coc[compact(mine), nation]
        if mine not in names and len(fit) == 1:
            out.add((mine, fit.pop()))
    return out


def test_suggestions_take_each_id_once(spark, tmp_path):
    rows = [(1, "Ab#1", 1), (2, "aB#1", 1), (3, "Ab#2", 1), (4, "A B#2", 1), (5, "Ab#3", 1), (6, "AB - 3", 1), (7, "AB-3", 2), (8, "C#4", 3), (9, "C D", 3), (10, "cd", 3), (11, "X-1", 1), (12, "x#1", 1), (13, "Y#7", 1)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = [tuple(r) for r in monitoring.id_suggestions(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) == len({c for _, c in got}) and set(got) == brute(rows)
    assert ("X - 1", "x#1") in got and ("Y - 7", "Y#7") in got
