from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallygrid import vocabulary as words
from tallygrid.operators import questions
from tallygrid.plans.governed import REPORT_ALIASES, Gold

from .conftest import dicts


def ask(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, question string")


def column(df, name):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["id"])]


REPORTS = [
    ("List the top 12 counties for 2016 through 2021", "top_counties_by_risk"),
    ("Where is the highest yearly loss expected?", "top_counties_by_risk"),
    ("worst places to build a house", "top_counties_by_risk"),
    ("Where was the biggest increase of recorded events, 2011 to 2019?", "largest_increase"),
    ("Where was the largest increase of flood events, 2016–2022?", "hazard_event_increase"),
    ("biggest growth in twister events since 2012", "hazard_event_increase"),
    ("most rise in typhoon disasters", "hazard_event_increase"),
    ("Kings County versus Orleans County", "county_comparison"),
    ("Hazards by year, 2012 to 2020", "hazard_trend_by_year"),
    ("How did all events develop over time?", "hazard_trend_by_year"),
    ("Droughts by year since 2013", "category_trend_specific"),
    ("Forest fires by year since 2013", "category_trend"),
    ("Which state filed the most federal declarations?", "fema_declarations_by_state"),
    ("worst hail for roofs", "top_counties_by_hazard"),
    ("Does Cook rank highest against other Illinois counties?", "top_counties_in_state"),
    ("Top counties in North Dakota", "top_counties_in_state"),
    ("good morning", "top_counties_by_risk"),
]


def test_reports(spark):
    tagged = questions.tag_template(ask(spark, [q for q, _ in REPORTS]))
    aliases = {**REPORT_ALIASES, "category_trend_specific": "category_trend_specific"}
    expected = [aliases.get(name, name) for _, name in REPORTS]
    assert column(tagged, "template") == expected


def test_increase_questions_split_their_range(spark):
    row = questions.tag_template(
        ask(spark, ["largest rise in flood events, 2015 until 2023"])
    ).first()
    assert (row["period_a_start"], row["period_a_end"]) == (2015, 2019)
    assert (row["period_b_start"], row["period_b_end"]) == (2020, 2023)
    default = questions.tag_template(ask(spark, ["Biggest rise in hazard events"])).first()
    assert (default["period_a_start"], default["period_a_end"]) == (2010, 2016)
    assert (default["period_b_start"], default["period_b_end"]) == (2017, 2023)


def test_order_column(spark):
    tagged = questions.tag_template(
        ask(spark, ["Highest tornado deaths", "Worst hail for people hurt", "Top flood counties",
                    "Top counties"])
    )
    assert column(tagged, "order_col") == ["total_severe", "total_minor", "total_events", None]


@pytest.mark.parametrize(
    ("question", "years"),
    [
        ("Events from 2018 to 2022", (2018, 2022)),
        ("from 2022 back to 2015 and 2017", (2015, 2022)),
        ("since 2015", (2015, 2023)),
        ("Top counties by risk", (2010, 2023)),
        ("in 1999 or 12018", (2010, 2023)),
        ("in 2031", (2031, 2031)),
    ],
)
def test_years(spark, question, years):
    row = questions.extract_years(ask(spark, [question])).first()
    assert (row["start_year"], row["end_year"]) == years


def test_limits(spark):
    texts = ["the top 10 places", "Top 25, please", "name 7 counties with most hail",
             "Which county is the deadliest?", "the safest county of all",
             "one county or two counties, the worst", "risk overview", "top 99999999999"]
    out = questions.extract_limit(ask(spark, texts))
    assert column(out, "row_limit") == [10, 25, 7, 1, 1, 10, 10, 10]


def test_every_phrase_maps_to_its_category(spark):
    phrases = list(words.CATEGORY_PHRASES)
    texts = [f"the largest increase in {p} events" for p in phrases]
    out = column(questions.extract_category(ask(spark, texts)), "category")
    assert out == [words.CATEGORY_PHRASES[p] for p in phrases]
    other = questions.extract_category(ask(spark, ["highest risk?", "wheat prices"]))
    assert column(other, "category") == ["all", "Excessive Heat"]


def test_states(spark):
    texts = ["Harris County, TX", "risk in west virginia", "Harrison County MO",
             "counties in new mexico and texas", "in XX", "IN THE END", "kansasville"]
    out = column(questions.extract_group(ask(spark, texts)), "group_name")
    assert out == ["Texas", "West Virginia", "Missouri", "New Mexico", "", "", ""]


def test_entities(spark):
    texts = ["risk for 48201 or Harris County", "What about Miami-Dade County?",
             "Los Angeles county vs Cook County", "no place"]
    out = questions.extract_entities(questions.extract_entity(ask(spark, texts)))
    assert column(out, "entity") == ["48201", "Miami-Dade", "Los Angeles", None]
    assert column(out, "entities")[2] == ["Los Angeles", "vs Cook"] or \
        column(out, "entities")[2][0] == "Los Angeles"


ROUTES = [
    ("Ranking of places by predicted risk", ["query"]),
    ("Where was the lowest number of hail reports?", ["query"]),
    ("What makes deltas flood, and what causes surges?", ["ask"]),
    ("total loss and risk level of Kings County", ["predict", "query"]),
    ("Compare both coasts and explain the gap", ["query", "ask"]),
    ("Tell me the risk tier of Butte", ["predict"]),
    ("What is resilience?", ["ask"]),
]


def test_routes(spark):
    routed = questions.route_questions(ask(spark, [q for q, _ in ROUTES]))
    assert column(routed, "tools") == [t for _, t in ROUTES]
    assert column(routed, "is_hybrid") == [len(t) > 1 for _, t in ROUTES]
    totals = {r["tools"]: r["questions"] for r in
              questions.routing_distribution(routed).collect()}
    assert totals == {"query": 2, "ask": 2, "predict+query": 1, "query+ask": 1, "predict": 1}


def test_screen(spark):
    bad = ["SELECT * FROM t", " drop table x", "x; DELETE FROM y", "please INSERT  INTO z",
           "1; truncate table q", "execute order"]
    good = ["Which counties select grants?", "drop in events", "Update on floods? no"]
    out = column(questions.screen_questions(ask(spark, bad + good)), "is_injection")
    assert out == [True] * len(bad) + [False, True, True]


def test_coverage(spark):
    out = questions.coverage_flags(ask(spark, ["1950 vs 2015 and 1950, 1800", "2012 only"]))
    assert column(out, "years_outside") == [[1800, 1950], []]
    assert column(out, "is_outside") == [True, False]


def test_notes_keep_their_order(spark):
    rows = [
        (0, "floods in 1950", "top_entities_by_score", 5, True),
        (1, "flood risk", "top_entities_by_score", 0, True),
        (2, "flood risk", "top_entities_by_score", 5, True),
        (3, "hurricane trend", "category_trend", 5, True),
        (4, "wildfire trend", "category_trend", 5, False),
        (5, "wildfire trend", "category_trend_specific", 5, True),
        (6, "counties at risk of hail", "top_entities_by_category", 5, True),
        (7, "hail counties", "top_entities_by_category", 5, True),
        (8, "top counties", "top_entities_by_score", 5, False),
    ]
    df = spark.createDataFrame(
        rows, "id int, question string, template string, row_count int, all_zero boolean"
    )
    assert column(questions.quality_notes(df), "note") == [
        "years", "", "not_filtered", "storm_record", "", "fire_record", "frequency",
        "all_zero", "",
    ]


def test_all_zero(spark):
    df = spark.createDataFrame(
        [("0", 0, ""), ("0.0", 0, None), ("x", 0, "3")], "a string, b int, c string"
    )
    check = questions.all_zero_check
    assert check(df, ["a", "b", "absent"]).first()["all_zero"]
    assert not check(df, ["a", "c"]).first()["all_zero"]
    assert not check(df, ["absent"]).first()["all_zero"]
    assert not check(df.limit(0), ["a"]).first()["all_zero"]


def test_tagging_is_map_only(spark):
    tagged = questions.tag_template(ask(spark, ["top 5"]))
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert dicts(tagged)


def test_all_zero_of_several_lists_in_one_scan(spark):
    df = spark.createDataFrame([("0", 0.0, 1), ("", 0.0, 0)], "a string, b double, c int")
    checks = questions.all_zero_checks(df, {"ab": ["a", "b"], "c": ["c"], "none": ["d"]})
    assert [(r["columns"], r["nonzero_rows"], r["all_zero"]) for r in checks.collect()] == [
        ("ab", 0, True), ("c", 1, False), ("none", 0, False)]


def test_notes_from_executed_reports(spark, county_mart, county_events, county_dim):
    gold = Gold(county_mart, county_events, county_dim)
    done, note = gold.noted("Top 3 counties with the most floods 2019-2022")
    assert done.report == "top_entities_by_category" and done.row_count == len(done.rows) == 3
    assert not done.all_zero and note == ""
    assert gold.noted("Which counties are most at risk of wildfire?")[1] in (
        "not_filtered", "fire_record", "")
    calm = Gold(
        county_mart, county_events.withColumns({
            c: F.lit(0) for c in ("event_count", "fatalities", "injuries")}), county_dim)
    facts = {r["template"]: r for r in calm.facts({
        "category_trend": {"category": "Flood", "start_year": 2019, "end_year": 2022},
        "group_totals": {"start_year": 2019, "end_year": 2022},
        "top_entities_in_group": {"start_year": 2019, "end_year": 2022, "group": "nowhere"},
    }).collect()}
    assert facts["group_totals"]["row_count"] > 0 and not facts["group_totals"]["all_zero"]
    assert facts["top_entities_in_group"]["row_count"] == 0
    assert not facts["top_entities_in_group"]["all_zero"]
    assert facts["category_trend"]["row_count"] == 4
