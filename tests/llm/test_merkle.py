from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tallygrid.llm.merkle import LEVELS, audit, content_digest, records, tree
from tallygrid.llm.queries import op1

SCHEMA = "archive string, offset bigint, body string"


def leaves(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return records(df, F.col("archive"), F.col("offset"), F.octet_length("body"),
                   content_digest(F.col("body")))


def places(a, b):
    return {(r["archive"], r["offset"], r["fault"]) for r in audit(a, b).collect()}


ROWS = [(f"f{k}", i * 9_000, f"body {k} {i}") for k in range(3) for i in range(120)]


def test_damage_is_found_where_it_is(spark):
    other = list(ROWS)
    other[5] = ("f0", 5 * 9_000, "body 0 ?")
    del other[130]
    other.append(("f2", 10**12, "more"))
    other.append(("f9", 0, "new file"))
    found = places(leaves(spark, ROWS), leaves(spark, other))
    assert found == {("f0", 45_000, "changed"), ("f1", 90_000, "missing"),
                     ("f2", 10**12, "extra"), ("f9", 0, "extra")}


def test_equal_copies_have_equal_roots(spark):
    a, b = leaves(spark, ROWS), leaves(spark, ROWS[::-1])
    assert audit(a, b).count() == 0
    roots = [{r["archive"]: r["digest"] for r in tree(x).filter(F.col("level") == LEVELS).collect()}
             for x in (a, b)]
    assert roots[0] == roots[1] and len(set(roots[0].values())) == 3


def test_nulls_repeats_and_empty_copies(spark):
    rows = [(None, 0, "a"), ("x", None, "b"), ("x", 0, None), ("x", 70_000, ""),
            ("x", 5, "twice"), ("x", 5, "twice"), (None, None, None), ("long", 0, "z" * 500_000)]
    assert audit(leaves(spark, rows), leaves(spark, rows)).count() == 0
    other = [(None, 0, "A"), ("x", None, "B"), ("x", 0, ""), ("x", 70_000, None),
             ("x", 5, "twice"), (None, None, "c"), ("long", 0, "z" * 499_999 + "y")]
    assert places(leaves(spark, rows), leaves(spark, other)) == {
        (None, 0, "changed"), ("x", None, "changed"), ("x", 0, "changed"),
        ("x", 70_000, "changed"), ("x", 5, "changed"), (None, None, "changed"),
        ("long", 0, "changed")}
    assert len(places(leaves(spark, ROWS[:7]), leaves(spark, []))) == 7
    assert audit(leaves(spark, []), leaves(spark, [])).count() == 0


def test_pages_without_ids_and_repeated_ids_are_audited(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<p>page {i}</p>" * 5) for i in range(300)]
    rows += [(None, f"http://b/{i}", f"<p>nameless {i}</p>" * 5) for i in range(300)]
    rows += [(i, f"http://a/{i}", f"<p>again {i}</p>" * 5) for i in range(150)]
    rows += [(4096 * 9, None, None), (None, None, "x" * 300_000)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(
        f"{tmp_path}/pages.parquet")
    found = op1.op1_merkle_fixity(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    asked = duck.execute(op1.ORACLES["op1_merkle_fixity"])
    names = [c[0] for c in asked.description]
    expected = sorted(map(str, asked.fetchall()))
    got = found.select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == expected
    assert {r["fault"] for r in got if r["archive"] < 0} == {"missing", "changed"}


def test_levels_are_read_from_files(spark):
    # a checkpoint keeps one task for every partition of every level that was written
    a, b = (leaves(spark, [("f", 0, x)]) for x in "xy")
    plan = audit(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan
