"""The registered queries: contract, parity with SQL on the smallest data, plan shapes."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from workload.gold import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no supplied tables")

# A sample over all subjects; tools/compare.py runs every query on larger tables.
SAMPLE = (
    "top_entities_by_score", "largest_increase", "resolve_entity", "feature_table",
    "feature_matrix", "stratified_split", "tertile_by_rank", "drift_report", "outliers_iqr",
    "chunk_documents", "cosine_topk", "tag_template", "route_questions", "eval_by_tool",
    "rubric_score", "classification_metrics", "scalar_smoke",
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')"
        )
    return connection


def test_contract():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {q for q in queries if not q.startswith("op") and q != "pipeline"}
    assert own <= set(oracles)


def test_flagship_has_rows(spark):
    assert contract.entry(spark).count() == 10


@pytest.mark.parametrize("name", SAMPLE)
def test_parity(spark, duck, name):
    left = contract.queries()[name](spark, SF).toArrow()
    right = duck.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert sorted(left.column_names) == sorted(right.column_names)

    def rows(table):
        columns = [table.column(c).to_pylist() for c in sorted(table.column_names)]
        return sorted(zip(*columns, strict=True), key=repr)

    assert rows(left) == rows(right)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(contract.queries()["yearly_trend"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate,1995-01-01" in text
    assert "l_tax" not in text and "l_linestatus" not in text


def test_ranking_ends_in_a_bounded_sort(spark):
    text = plan(contract.queries()["top_entities_by_score"](spark, SF))
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["resolve_entity", "category_increase", "feature_table",
                                  "drift_report", "stratified_split", "grounding_check"])
def test_no_cross_joins(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_two_periods_take_one_scan(spark):
    text = plan(contract.queries()["largest_increase"](spark, SF))
    initial = text.split("== Initial Plan ==")[-1]
    assert initial.count("lineitem.parquet") == 1
