from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallygrid.llm.url_filters import judge, lookup_keys, validity


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


CHANGES = [
    ("a", "host", "x.example.com", day(10), True), ("a", "host", "x.example.com", day(20), False),
    ("a", "host", "x.example.com", day(10), True), ("a", "host", "x.example.com", day(30), True),
    ("b", "domain", "example.com", day(15), True), ("b", "domain", "example.com", day(15), True),
    ("c", "url", "y.org/p", day(5), True), ("c", "url", "y.org/p", day(5), False),
    ("d", "url", "y.org/q", day(5), True), (None, "url", "y.org/q", day(5), True),
    ("e", "host", None, day(5), True), ("f", "host", "y.org", None, True),
]
SCHEMA = "list string, kind string, key string, at date, added boolean"


def test_intervals(spark):
    rows = {(r["list"], r["since"], r["until"])
            for r in validity(spark.createDataFrame(CHANGES, SCHEMA)).collect()}
    assert rows == {("a", day(10), day(20)), ("a", day(30), None), ("b", day(15), None),
                    ("d", day(5), None)}


def test_captures_meet_what_was_active(spark):
    urls = [(1, "https://X.example.com:80/a", 9), (2, "http://x.example.com/", 10),
            (3, "http://x.example.com", 20), (4, "http://u@x.example.com?q", 30),
            (5, "http://y.org/p", 6), (6, "http://y.org/q/?x=1#f", 6), (7, None, 6),
            (8, "", 6), (9, "http://y.org/q", None), (6, "http://y.org/q/?x=1#f", 6),
            (10, "no host", 6), (11, "http://badexample.com/", 40)]
    captures = spark.createDataFrame(
        [(i, u, None if d is None else day(d), "mine") for i, u, d in urls],
        "page_id bigint, url string, fetched_at date, lists string")
    intervals = validity(spark.createDataFrame(CHANGES, SCHEMA))
    rows = judge(captures, intervals).collect()
    assert len(rows) == len(urls)
    got = {r["page_id"]: (r["blocked"], r["n_entries"], r["lists"], r["first_match"]) for r in rows}
    clear = (False, 0, "", None)
    assert got == {
        1: clear, 2: (True, 1, "a", "host:x.example.com"), 3: (True, 1, "b", "domain:example.com"),
        4: (True, 2, "a,b", "domain:example.com"), 5: clear, 6: (True, 1, "d", "url:y.org/q"),
        7: clear, 8: clear, 9: clear, 10: clear, 11: clear}
    assert judge(captures.filter(F.lit(False)), intervals).count() == 0
    assert judge(captures, intervals.filter(F.lit(False))).filter("blocked").count() == 0


def test_keys(spark):
    row = spark.range(1).select(lookup_keys(F.lit("http://A.b.co/x/")).alias("k")).first()
    assert set(row["k"]) == {"url:A.b.co/x", "host:a.b.co", "domain:a.b.co", "domain:b.co",
                             "domain:co"}


def test_names_of_the_lookup_may_be_columns_of_the_captures(spark):
    captures = spark.createDataFrame(
        [("http://x.example.com/", day(10), "u", 7, "k", "s")],
        "url string, fetched_at date, _url string, _AT int, key string, _spans string")
    intervals = validity(spark.createDataFrame(CHANGES, SCHEMA))
    (row,) = judge(captures, intervals).collect()
    assert (row["_url"], row["_AT"], row["key"], row["_spans"]) == ("u", 7, "k", "s")
    assert row["blocked"] and row["lists"] == "a"
