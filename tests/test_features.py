from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid import vocabulary as words
from tallygrid.operators import features
from tallygrid.plans import jobs
from tallygrid.schemas import COUNTY, FeatureSpec

from .conftest import dicts


@pytest.fixture(scope="module")
def panel(spark):
    rows = [
        ("01001", y, e, d, s, "AL")
        for y, e, d, s in [(2019, 5, 100.0, 1.0), (2020, 7, None, 2.0), (2021, 6, 180.0, -3.0),
                           (2022, 8, 220.0, 4.0)]
    ] + [
        ("12086", y, e, d, s, "FL")
        for y, e, d, s in [(2019, 12, 500.0, 5.0), (2020, 14, 750.0, 6.0),
                           (2021, 11, 600.0, 7.0), (2022, 13, 650.0, 8.0)]
    ]
    return spark.createDataFrame(
        rows, "county_fips string, year int, total_events int, damage double, loss double, "
        "state string",
    )


def test_log_clips_negatives_and_skips_absent_columns(panel):
    out = features.log_features(panel, ["loss", "absent"])
    values = {(r["county_fips"], r["year"]): r["loss_log"] for r in out.collect()}
    assert values[("01001", 2021)] == 0.0
    assert values[("01001", 2019)] == pytest.approx(math.log(2))
    assert "absent_log" not in out.columns


def test_imputed_value_is_the_median(panel):
    out = features.median_impute(panel, ["damage"])
    filled = out.filter("county_fips = '01001' AND year = 2020").first()["damage"]
    assert filled == np.median([100, 180, 220, 500, 750, 600, 650])


def test_lags_stay_inside_an_entity(panel):
    out = features.lag_features(panel, ["total_events"], (1, 2), "county_fips", "year")
    rows = {(r["county_fips"], r["year"]): r for r in out.collect()}
    assert rows[("01001", 2020)]["total_events_lag1"] == 5
    assert rows[("01001", 2019)]["total_events_lag1"] is None
    assert rows[("12086", 2019)]["total_events_lag1"] is None
    assert rows[("12086", 2021)]["total_events_lag2"] == 12
    assert features.lag_features(panel.drop("year"), ["total_events"], key="county_fips") \
        .columns == panel.drop("year").columns


def test_one_hot_drops_the_first_level(panel):
    out = features.one_hot(panel, ["state"])
    assert "state_FL" in out.columns and "state_AL" not in out.columns
    assert "state" not in out.columns
    assert out.filter("county_fips = '12086'").first()["state_FL"] == 1.0


def test_one_hot_uses_fitted_levels_on_a_single_row(panel):
    one = panel.filter("county_fips = '12086'").limit(1)
    out = features.one_hot(one, ["state"], {"state": ["AL", "FL", "TX"]}).first()
    assert (out["state_FL"], out["state_TX"]) == (1.0, 0.0)


def test_pipeline_order_whitelist_and_round_trip(spark, panel, tmp_path):
    spec = FeatureSpec(
        numeric=("total_events", "damage"), log=("damage",), lag=("total_events",), lags=(1,),
        categorical=("state",), key="county_fips", drop=(), passthrough=("county_fips", "year"),
    )
    fitted = features.FeaturePipeline(spec).fit(panel)
    out = fitted.transform(panel)
    # the lag is listed nowhere, so only its boundary rows leave a trace
    assert set(out.columns) == {
        "county_fips", "year", "total_events", "damage", "damage_log", "state_FL"
    }
    assert out.count() == 6
    assert not any(v is None for r in out.collect() for v in r)
    row = out.filter("county_fips = '01001' AND year = 2020").first()
    assert row["damage_log"] == pytest.approx(math.log1p(500.0))
    fitted.save(spark, str(tmp_path / "fit"))
    loaded = features.FittedFeatures.load(spark, str(tmp_path / "fit"))
    assert loaded == fitted
    assert loaded.feature_names(out.columns) == [
        c for c in out.columns if c not in ("county_fips", "year")
    ]


def test_fitted_values_do_not_depend_on_scored_rows(panel):
    spec = FeatureSpec(numeric=("damage",), key="county_fips", passthrough=("county_fips",))
    fitted = features.FeaturePipeline(spec).fit(panel)
    other = panel.filter("year = 2020").withColumn("damage", F.lit(None).cast("double"))
    assert {r["damage"] for r in fitted.transform(other).collect()} == {500.0}


def test_align(panel):
    out = features.align_features(panel, ["absent", "damage"])
    assert out.columns == ["absent", "damage"]
    assert out.filter("damage = 0").count() == 1
    left, right = features.align_train_test(panel, panel.drop("loss").withColumn("x", F.lit(1)))
    assert left.columns == right.columns and "loss" not in left.columns


def test_unknown_label_fails(spark):
    good = spark.createDataFrame([("LOW", 1.0), ("HIGH", 2.0)], "risk_bucket string, x double")
    coded, numeric = features.label_encode(good)
    assert [r["label"] for r in coded.collect()] == [0, 2]
    assert numeric == ["x"]
    bad = spark.createDataFrame([("LOUD", 1.0)], "risk_bucket string, x double")
    with pytest.raises(Exception, match="Unmapped label"):
        features.label_encode(bad)[0].collect()


def test_base_pivot_and_table(county_mart, county_events, county_dim):
    table = jobs.county_features(county_mart, county_events, county_dim)
    rows = {r["county_fips"]: r for r in table.collect()}
    # no score, no row; no events, zeros
    assert set(rows) == {"01001", "01003", "48201", "21097", "48203"}
    assert rows["21097"]["flood_events"] == 0
    assert rows["01001"]["flood_events"] == 14
    assert rows["01001"]["flood_total_damage"] == 5 * 10.0 + 9 * 20.0
    assert rows["01001"]["heat_events"] == 6
    assert rows["48203"]["flood_events"] == 3
    assert rows["01001"]["noaa_total_property_damage"] == 50.0 + 180.0 + 0 + 4.0
    assert rows["48201"]["unemployment_rate"] == pytest.approx(0.05)
    assert rows["48201"]["events_per_capita"] == pytest.approx(17 / 24_500)
    assert "heat_total_damage" not in table.columns
    pivot = features.category_pivot(
        county_events, words.COUNTY_FAMILIES, words.DAMAGE_FAMILIES, COUNTY
    )
    assert sum(c.endswith("_events") for c in pivot.columns) == 11
    assert sum(c.endswith("_total_damage") for c in pivot.columns) == 9


def test_entities_without_dimension_row_keep_a_null_group(county_mart, county_dim):
    base = features.feature_base(
        county_mart, county_dim.filter("state <> 'Texas'"), ["fema_total_damage"], [], [], COUNTY
    )
    assert {r["county_fips"] for r in base.filter("state IS NULL").collect()} == {
        "48201", "48203"
    }


def test_entity_features_leave_out_money_totals(county_mart, county_events, county_dim):
    table = jobs.county_features(county_mart, county_events, county_dim)
    one = features.entity_features(table, county_dim.filter("county_name = 'Harris'"), COUNTY)
    assert [r["county_fips"] for r in dicts(one)] == ["48201"]
    assert not any(c.endswith("total_damage") for c in one.columns)
