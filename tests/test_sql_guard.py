from __future__ import annotations

import pytest

from tallygrid.plans.governed import Gold
from tallygrid.plans.sql_guard import Refused, run_sql


@pytest.fixture
def gold(county_mart, county_events, county_dim):
    return Gold(county_mart, county_events, county_dim)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_queries_run(gold, spark):
    assert rows(gold.sql("SELECT COUNT(*) FROM mart")) == [(gold.mart.count(),)]
    text = """WITH per AS (SELECT county_fips, SUM(event_count) AS n FROM gold.events
        GROUP BY county_fips HAVING SUM(event_count) > 2)
      SELECT e.county_name, p.n, ROW_NUMBER() OVER (ORDER BY p.n DESC) AS r
      FROM per p JOIN GOLD.entity e ON e.county_fips = p.county_fips
      WHERE e.state IN (SELECT state FROM entity) AND e.state LIKE 'T%' -- ) comment
      ORDER BY 3 LIMIT 1;"""
    assert [r[0] for r in rows(gold.sql(text, database="gold"))] == ["Harris"]
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("_guarded")]


def test_never_more_rows_than_allowed(gold, spark):
    many = spark.range(500).toDF("k")
    assert run_sql({"t": many}, "SELECT * FROM t", 100).count() == 100
    assert run_sql({"T": many}, "SELECT * FROM t LIMIT 400", 100).count() == 100
    assert run_sql({"t": many}, "SELECT k FROM t ORDER BY k DESC", 3).collect()[0][0] == 499
    assert gold.sql("SELECT * FROM mart", limit=10_000).count() <= 100
    with pytest.raises(ValueError):
        run_sql({"t": many}, "SELECT * FROM t", 0)


def test_names_mean_the_given_tables_whatever_the_session_holds(gold, spark):
    spark.range(3).createOrReplaceTempView("mart")
    try:
        assert gold.sql("SELECT COUNT(*) FROM mart").first()[0] == gold.mart.count()
        assert spark.table("mart").count() == 3
    finally:
        spark.catalog.dropTempView("mart")


@pytest.mark.parametrize("query", [
    "", " ; ", None, "SELEC 1", "SELECT 1", "DROP TABLE mart", "DELETE FROM mart",
    "INSERT INTO mart VALUES (1)", "UPDATE mart SET year = 1", "TRUNCATE TABLE mart",
    "ALTER TABLE mart ADD COLUMN x INT", "CREATE TABLE x AS SELECT * FROM mart",
    "CREATE VIEW v AS SELECT * FROM mart", "SELECT * FROM mart; DROP TABLE mart",
    "SET spark.sql.shuffle.partitions=1", "SHOW TABLES", "DESCRIBE mart", "EXPLAIN SELECT 1",
    "CACHE TABLE mart", "ADD JAR '/x.jar'", "USE other", "REFRESH TABLE mart",
    "SELECT * FROM secret", "SELECT * FROM other.mart", "SELECT * FROM mart, secret",
    "SELECT * FROM parquet.`/etc`", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM range(10)",
    "SELECT (SELECT MAX(id) FROM secret) FROM mart",
    "SELECT * FROM mart WHERE EXISTS (SELECT 1 FROM secret)",
    "WITH a AS (SELECT * FROM secret) SELECT * FROM a JOIN mart ON true",
    "WITH mart AS (SELECT 1) SELECT * FROM mart",
    "SELECT * FROM (VALUES (1)) t JOIN mart ON year = col1",
    "SELECT java_method('java.lang.System', 'exit', '1') FROM mart",
    "SELECT reflect('java.lang.System', 'exit', '1') FROM mart",
    "SELECT input_file_name() FROM mart", "SELECT explode(sequence(1, year)) FROM mart",
    "SELECT * FROM mart LATERAL VIEW explode(array(1)) t", "SELECT no_such_function(year) FROM mart",
    "SELECT db.f(year) FROM mart", "SELECT repeat('x', 1000000000) FROM mart",
    "SELECT TRANSFORM(year) USING 'cat' AS (x) FROM mart",
    "SELECT /*+ BROADCAST(mart) */ * FROM mart", "SELECT * FROM mart) t, (SELECT 1",
    "SELECT nothing FROM mart", "SELECT COUNT(*) FROM mart a, mart b",
    "SELECT COUNT(*) FROM mart a CROSS JOIN events b",
    "SELECT COUNT(*) FROM mart a JOIN events b ON a.year < b.year",
])
def test_everything_else_is_refused(gold, query):
    with pytest.raises(Refused):
        gold.sql(query, database="gold").collect()


def test_a_registered_function_is_not_built_in(gold, spark):
    spark.udf.register("leak", lambda v: str(v))
    with pytest.raises(Refused):
        gold.sql("SELECT leak(year) FROM mart")
    spark.sql("DROP TEMPORARY FUNCTION leak")
