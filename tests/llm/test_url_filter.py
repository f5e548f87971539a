import datetime as dt

from pyspark.sql import functions as F

from assaylake.llm import url_filter

D = dt.date


def test_intervals(spark):
    events = [("a.com", "block", "add", D(2024, 1, 1)), ("a.com", "block", "add", D(2024, 1, 5)), ("a.com", "block", "remove", D(2024, 2, 1)), ("a.com", "block", "remove", D(2024, 2, 2)), ("a.com", "block", "add", D(2024, 3, 1)), ("b.com", "block", "remove", D(2024, 1, 1)), ("c.com", "block", "add", D(2024, 1, 1)), ("c.com", "block", "remove", D(2024, 1, 1)), (None, "block", "add", D(2024, 1, 1)), ("d.com", "block", "add", None)]
    got = sorted(map(tuple, url_filter.intervals(spark.createDataFrame(events, "key string, action string, event string, at date")).collect()))
    assert got == [("a.com", "block", D(2024, 1, 1), D(2024, 2, 1)), ("a.com", "block", D(2024, 3, 1), D(9999, 12, 31))]


def test_as_of_verdicts(spark):
    events = spark.createDataFrame(
        [("example.com", "block", "add", D(2024, 1, 10)), ("example.com", "block", "remove", D(2024, 2, 1)), ("www.example.com", "allow", "add", D(2024, 1, 20)), ("www.example.com/x", "block", "add", D(2024, 1, 1))],
        "key string, action string, event string, at date",
    )
    rows = [
        (1, "http://www.example.com/", D(2024, 1, 9)),
        (2, "http://WWW.example.com:80/", D(2024, 1, 10)),
        (3, "https://u:p@www.example.com/y?q", D(2024, 1, 25)),
        (4, "http://www.example.com/x/y", D(2024, 1, 25)),
        (5, "http://example.com/", D(2024, 1, 31)),
        (6, "http://example.com/", D(2024, 2, 1)),
        (7, None, D(2024, 1, 15)),
        (8, "not a url", D(2024, 1, 15)),
        (9, "http://example.com/", None),
        (None, "http://example.com/", D(2024, 1, 15)),
        (5, "http://example.com/", D(2024, 1, 31)),
    ]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date").withColumnsRenamed({})
    got = sorted(((r.page_id or -1, r.verdict, r.entry, r.n_active) for r in url_filter.evaluate(captures, events).collect()), key=str)
    want = [(1, "unlisted", None, 0), (2, "block", "example.com", 1), (3, "allow", "www.example.com", 2), (4, "block", "www.example.com/x", 3), (5, "block", "example.com", 1), (5, "block", "example.com", 1), (6, "unlisted", None, 0), (7, "unlisted", None, 0), (8, "unlisted", None, 0), (9, "unlisted", None, 0), (-1, "block", "example.com", 1)]
    assert got == sorted(want, key=str)
    assert url_filter.evaluate(captures.limit(0), events.limit(0)).count() == 0


def test_rows_without_a_host_and_clashing_columns(spark):
    events = spark.createDataFrame([("a.org", "block", "add", "2024-01-05")], "key string, action string, event string, at string").withColumn("at", F.col("at").cast("date"))
    rows = [(2**60 + 1, "http://a.org/x"), (None, "http://a.org/y"), (3, None), (4, "no url"), (5, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("fetched", F.lit("2024-02-01").cast("date"))
    odd = pages.withColumns({name: F.lit("x") for name in ("rid", "host", "key", "entry", "action", "verdict", "valid_from", "n_active")})
    got = {(r.page_id, r.host, r.verdict, r.n_active) for r in url_filter.evaluate(odd, events).collect()}
    assert got == {(2**60 + 1, "a.org", "block", 1), (None, "a.org", "block", 1), (3, None, "unlisted", 0), (4, None, "unlisted", 0), (5, None, "unlisted", 0)}
