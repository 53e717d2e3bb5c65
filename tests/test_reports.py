"""Governed reports over a small county data set."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import ranking, resolve, trends
from tallygrid.plans.governed import MAX_LIMIT, Gold, validate
from tallygrid.schemas import COUNTY, COUNTY_DIM, Names, require_columns

from .conftest import dicts


@pytest.fixture(scope="module")
def gold(county_mart, county_events, county_dim):
    return Gold(county_mart, county_events, county_dim)


def test_top_by_score_orders_and_breaks_ties_by_entity(gold):
    rows = dicts(gold.run("top_counties_by_risk", start_year=2019, end_year=2022, limit=10))
    assert [r["county_fips"] for r in rows] == [
        "48201", "01003", "48203", "01001", "21097", "12086"
    ]
    assert rows[0]["avg_loss_score"] == 99.5
    assert rows[4]["years_on_record"] == 2
    assert rows[5]["avg_loss_score"] is None


def test_top_in_state_ignores_case(gold):
    rows = dicts(
        gold.run("top_counties_in_state", state_name="TeXas", start_year=2019, end_year=2022)
    )
    assert [r["county_name"] for r in rows] == ["Harris", "Harrison"]


def test_comparison_lists_years_in_order(gold):
    rows = dicts(
        gold.run(
            "county_comparison", county_fips_list="'48201','12086'", start_year=2021,
            end_year=2022,
        )
    )
    assert [(r["county_fips"], r["year"]) for r in rows] == [
        ("12086", 2021), ("12086", 2022), ("48201", 2021), ("48201", 2022)
    ]


def test_group_totals_use_real_division(gold):
    rows = {
        r["state"]: r
        for r in dicts(
            gold.run("fema_declarations_by_state", start_year=2019, end_year=2019, limit=50)
        )
    }
    # 5 // 2 + 10 // 2 = 7 declarations in two counties
    assert rows["Alabama"]["total_declarations"] == 7
    assert rows["Alabama"]["avg_declarations_per_entity"] == 3.5


def test_yearly_trend_counts_entities(gold):
    rows = dicts(gold.run("hazard_trend_by_year", start_year=2019, end_year=2022))
    assert [r["year"] for r in rows] == [2019, 2020, 2021, 2022]
    assert [r["entities_affected"] for r in rows] == [6, 6, 5, 5]


def test_largest_increase_equals_self_join(gold, county_mart, county_dim):
    one_pass = gold.run(
        "largest_increase", period_a_start=2019, period_a_end=2020, period_b_start=2021,
        period_b_end=2022,
    )

    def period(a, b, name):
        return county_mart.filter(F.col("year").between(a, b)).groupBy("county_fips").agg(
            F.avg("noaa_event_count").alias(name)
        )

    joined = period(2019, 2020, "a").join(period(2021, 2022, "b"), "county_fips")
    expected = {
        r["county_fips"]: round(r["b"] - r["a"], 2) for r in joined.collect()
    }
    got = {r["county_fips"]: r["absolute_increase"] for r in one_pass.collect()}
    assert got == expected
    assert "21097" not in got
    assert one_pass.first()["county_fips"] == "48201"


def test_category_increase_sums_and_keeps_growth_only(gold):
    rows = dicts(
        gold.run(
            "hazard_event_increase", hazard_type="Flood", period_a_start=2019,
            period_a_end=2020, period_b_start=2021, period_b_end=2022,
        )
    )
    # 01003 shrinks from 7 to 6
    assert [(r["county_fips"], r["absolute_increase"]) for r in rows] == [
        ("48201", 10), ("01001", 4)
    ]
    assert rows[0]["pct_increase"] == 500.0


def test_combined_categories_keep_a_row_per_spelling(gold):
    rows = dicts(
        gold.run(
            "top_counties_by_hazard", hazard_type="Heat", order_col="total_events",
            start_year=2019, end_year=2022,
        )
    )
    assert [(r["hazard_type"], r["total_events"]) for r in rows] == [
        ("Excessive Heat", 4), ("Heat", 2)
    ]


def test_only_heat_is_combined():
    families = (("Excessive Heat", "Heat"),)
    assert ranking.expand_categories("Excessive Heat", families) == ["Excessive Heat", "Heat"]
    assert ranking.expand_categories("Flood", families) == ["Flood"]


def test_merged_categories_are_one_row(county_events, county_dim):
    rows = dicts(
        ranking.top_entities_by_category(
            county_events, county_dim, ["Heat", "Excessive Heat"], 2019, 2022,
            merge_combined=True, names=COUNTY,
        )
    )
    assert [(r["hazard_type"], r["total_events"]) for r in rows] == [("Excessive Heat/Heat", 6)]


def test_casualty_ranking_drops_zero_rows(gold):
    rows = dicts(
        gold.run(
            "top_counties_by_hazard", hazard_type="Flood", order_col="total_fatalities",
            start_year=2019, end_year=2022,
        )
    )
    assert [(r["county_fips"], r["total_severe"]) for r in rows] == [("48201", 4), ("01001", 1)]


def test_category_trend_limit_keeps_earliest_years(gold):
    rows = dicts(
        gold.run("hazard_trend_specific", hazard_type="Flood", start_year=2019, end_year=2022,
                 limit=2)
    )
    assert [(r["year"], r["total_events"]) for r in rows] == [(2019, 13), (2020, 1)]


def test_latest_snapshot_needs_a_score(county_mart):
    latest = ranking.latest_snapshot(county_mart, names=COUNTY)
    assert {r["year"] for r in latest.collect()} == {2022}
    assert "12086" not in {r["county_fips"] for r in latest.collect()}
    assert ranking.latest_snapshot(county_mart, 2019, COUNTY).count() == 5


def test_rank_shares_ties(spark):
    report = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3)], "entity_id string, m int")
    rows = {r["entity_id"]: r["rank"] for r in ranking.entity_rank(report, "m").collect()}
    assert rows == {"a": 1, "b": 1, "c": 3}


def test_labels(county_dim):
    rows = ranking.entity_labels(county_dim, COUNTY).collect()
    assert "Harrison, Texas" in {r["label"] for r in rows}


def test_semi_events(county_events, county_dim):
    texas = county_dim.filter("state = 'Texas'")
    assert trends.semi_events(county_events, texas, COUNTY).count() == 5


@pytest.mark.parametrize(
    ("params", "message"),
    [
        ({"start_year": 1850, "end_year": 2020}, "start_year must be a covered year"),
        ({"start_year": 2015}, "needs end_year"),
        ({"start_year": 2015, "end_year": 2020, "x": 1}, "takes no 'x'"),
        ({"start_year": 2015, "end_year": 2020, "limit": 0}, "limit must be a positive"),
    ],
)
def test_bad_parameters(params, message):
    with pytest.raises(ValueError, match=message):
        validate("top_counties_by_risk", params)


def test_bad_values():
    years = {"start_year": 2015, "end_year": 2020}
    with pytest.raises(ValueError, match="hazard_type must be letters"):
        validate("hazard_trend_specific", {**years, "hazard_type": "flood'; DROP TABLE--"})
    with pytest.raises(ValueError, match="county_fips_list must be entity ids"):
        validate("county_comparison", {**years, "county_fips_list": "'; DROP TABLE x;--"})
    with pytest.raises(ValueError, match="order_col must be one of"):
        validate(
            "top_counties_by_hazard", {**years, "hazard_type": "Hail", "order_col": "1; --"}
        )
    with pytest.raises(ValueError, match="no report is called"):
        validate("everything", years)


def test_limit_is_clamped_and_ids_are_split():
    _, clean = validate(
        "county_comparison",
        {"start_year": 2015, "end_year": 2020, "limit": 999,
         "county_fips_list": "'48201', '12086'"},
    )
    assert clean["limit"] == MAX_LIMIT
    assert clean["ids"] == ["48201", "12086"]


def test_ranked_by(gold):
    assert gold.ranked_by("top_counties_by_hazard", order_col="total_injuries") == "total_minor"
    assert gold.ranked_by("hazard_event_increase") == "absolute_increase"
    assert gold.ranked_by("hazard_trend_by_year") == ""


def test_questions_run_their_report(gold):
    top = gold.answer("the 2 counties with the highest risk since 2019")
    assert [r["county_fips"] for r in top.collect()] == ["48201", "01003"]
    pair = gold.answer("Miami-Dade County versus 48201, which counties lead in 2021 and 2022")
    assert {r["county_fips"] for r in pair.collect()} == {"12086", "48201"}
    texas = gold.answer("top counties in Texas")
    assert {r["state"] for r in texas.collect()} == {"Texas"}
    deadly = gold.answer("Highest flood deaths, 2019 to 2022")
    assert [r["total_severe"] for r in deadly.collect()] == [4, 1]
    growth = gold.answer("biggest increase in flood events 2019 to 2022")
    assert growth.first()["county_fips"] == "48201"


def test_comparison_reads_the_state_after_a_name(gold):
    both = gold.answer("Compare Harrison County, TX versus Harrison County, KY from 2019 to 2022")
    assert {r["county_fips"] for r in both.collect()} == {"21097", "48203"}
    full = gold.answer("Compare Harrison County in Texas versus Harris County from 2019 to 2022")
    assert {r["county_fips"] for r in full.collect()} == {"48201", "48203"}
    with pytest.raises(ValueError, match="Kentucky, Texas"):
        gold.answer("Compare Harrison County versus Harris County from 2019 to 2022")


def test_resolution_prefers_exact_then_hyphen_then_prefix(spark, county_dim):
    lookups = spark.createDataFrame(
        [(1, "Harris", None), (2, "miami-dade", None), (3, "Harri", "texas"),
         (4, "Harrison", "Kentucky"), (5, "Nowhere", None), (6, "Bald", None)],
        "lookup_id int, name string, hint string",
    )
    found = {
        r["lookup_id"]: (r["county_fips"], r["priority"])
        for r in resolve.resolve_entity(
            lookups, county_dim, hint="hint", names=COUNTY
        ).collect()
    }
    assert found == {
        1: ("48201", 0), 2: ("12086", 1), 3: ("48201", 2), 4: ("21097", 0), 6: ("01003", 2)
    }


def test_punctuation_never_decides(spark):
    entity = spark.createDataFrame(
        [("1", "Prince George's", "Maryland"), ("2", "St. Louis", "Missouri"),
         ("3", "x" * 60 + "a", "Ohio"), ("4", "x" * 60 + "b", "Ohio")],
        "county_fips string, county_name string, state string",
    )
    lookups = spark.createDataFrame(
        [(1, "prince georges"), (2, "St. Louis"), (3, "X" * 60 + "B"), (4, None)],
        "lookup_id int, name string")
    found = {r["lookup_id"]: (r["county_fips"], r["priority"])
             for r in resolve.resolve_entity(lookups, entity, names=COUNTY).collect()}
    assert found == {1: ("1", 0), 2: ("2", 0), 3: ("4", 0)}


def test_ambiguous_names(county_dim):
    rows = dicts(resolve.ambiguous_names(county_dim, names=COUNTY))
    assert rows == [
        {"name": "harrison", "group_count": 2, "groups": ["Kentucky", "Texas"]}
    ]


def test_schema_check(county_dim):
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(county_dim.drop("state"), COUNTY_DIM)
    assert require_columns(county_dim, COUNTY_DIM).columns == COUNTY_DIM.names
    assert Names().entity == "entity_id"
