from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import drift

from .conftest import dicts


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    base = {
        "same": rng.normal(size=500),
        "shifted": rng.normal(size=500),
        "constant": np.full(50, 7.0),
        "few": rng.normal(size=9),
        "grid": np.arange(0, 2.05, 0.1),
    }
    recent = {
        "same": base["same"],
        "shifted": rng.normal(size=500) + 2,
        "constant": np.full(50, 7.0),
        "few": rng.normal(size=9),
        "grid": np.concatenate([np.arange(0, 2.05, 0.1), [-5.0, 99.0, np.nan]]),
    }

    def frame(values):
        rows = [
            (f, None if np.isnan(v) else float(v)) for f, vs in values.items() for v in vs
        ]
        return spark.createDataFrame(rows, "feature string, value double")

    return base, recent, frame(base), frame(recent)


def test_histogram_is_numpys(data):
    base, _, frame, _ = data
    rows = dicts(drift.histogram(frame))
    for feature, values in base.items():
        counts, edges = np.histogram(values, bins=20)
        mine = sorted((r for r in rows if r["feature"] == feature), key=lambda r: r["bin"])
        assert [r["rows"] for r in mine] == counts.tolist(), feature
        assert [r["edge_lo"] for r in mine] == pytest.approx(edges[:-1].tolist())
        assert sum(r["share"] for r in mine) == pytest.approx(1.0)


def test_recent_rows_outside_the_baseline_are_dropped(data):
    base, recent, base_frame, recent_frame = data
    rows = dicts(drift.recent_histogram(recent_frame, drift.histogram(base_frame)))
    for feature, values in base.items():
        edges = np.histogram(values, bins=20)[1]
        known = recent[feature][~np.isnan(recent[feature])]
        counts = np.histogram(known, bins=edges)[0]
        mine = sorted((r for r in rows if r["feature"] == feature), key=lambda r: r["bin"])
        assert [r["rows"] for r in mine] == counts.tolist(), feature


def test_kl_is_zero_for_equal_and_matches_the_formula(data):
    base, recent, base_frame, recent_frame = data
    reference = drift.histogram(base_frame)
    kl = {
        r["feature"]: r["kl_divergence"]
        for r in drift.kl_drift(
            drift.recent_histogram(recent_frame, reference), reference
        ).collect()
    }
    assert kl["same"] == pytest.approx(0, abs=1e-12)
    edges = np.histogram(base["shifted"], bins=20)[1]
    p = np.histogram(recent["shifted"], bins=edges)[0]
    q = np.histogram(base["shifted"], bins=edges)[0]
    p, q = p / p.sum() + 1e-10, q / q.sum() + 1e-10
    p, q = p / p.sum(), q / q.sum()
    assert kl["shifted"] == pytest.approx(float((p * np.log(p / q)).sum()))


def test_baseline_stats(data):
    base, _, frame, _ = data
    rows = {r["feature"]: r for r in drift.baseline_stats(frame).collect()}
    for feature, values in base.items():
        row = rows[feature]
        assert row["mean"] == pytest.approx(values.mean())
        assert row["std"] == pytest.approx(values.std(ddof=1))
        assert row["p25"] == pytest.approx(np.quantile(values, 0.25))
        assert row["p75"] == pytest.approx(np.quantile(values, 0.75))


def test_report_skips_thin_features_and_summary_counts_all(data):
    _, _, base_frame, recent_frame = data
    report = drift.drift_report(
        recent_frame, drift.baseline_stats(base_frame), drift.histogram(base_frame)
    )
    rows = {r["feature"]: r for r in report.collect()}
    assert set(rows) == {"same", "shifted", "constant", "grid"}
    assert rows["shifted"]["is_drifted"] and not rows["same"]["is_drifted"]
    assert rows["shifted"]["mean_shift"] > 1.5
    summary = drift.drift_summary(report).first()
    assert summary["total_features_checked"] == 4
    assert summary["drifted_features"] == ["shifted"]
    assert summary["drift_detected"]


def test_wide_frames_become_long(spark):
    wide = spark.createDataFrame([(1, 2.0), (None, 3.0)], "a int, b double")
    rows = {(r["feature"], r["value"]) for r in drift.to_long(wide, ["a", "b", "x"]).collect()}
    assert rows == {("a", 1.0), ("b", 2.0), ("b", 3.0)}


def test_label_drift(spark):
    base = spark.createDataFrame([("x",)] * 50 + [("y",)] * 50, "label string")
    recent = spark.createDataFrame([("x",)] * 95 + [("z",)] * 5, "label string")
    assert drift.label_drift(base, base, "label").first()["kl_divergence"] == 0.0
    row = drift.label_drift(recent, base, "label").first()
    assert row["is_drifted"] and row["labels"] == 3


def test_outliers(spark):
    df = spark.range(101).select(
        F.lit("f").alias("feature"),
        F.when(F.col("id") == 100, 1e6).otherwise(F.col("id").cast("double")).alias("value"),
    )
    row = drift.outliers_iqr(df).first()
    assert (row["rows"], row["outliers"]) == (101, 1)
    assert (row["lower_fence"], row["upper_fence"]) == (-50.0, 150.0)
