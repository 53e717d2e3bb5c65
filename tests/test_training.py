from __future__ import annotations

import pytest

from tallygrid.operators import modeling
from workload import training


class _Rows:
    def filter(self, condition):
        return self


class _Stop(Exception):
    pass


@pytest.mark.parametrize("name", [
    "train_classifier", "train_boosted", "cv_scores", "batch_score", "feature_importance"])
def test_queries_train_the_published_model(monkeypatch, name):
    used = []

    def train(df, features, label="label", params=None, **more):
        used.append({**modeling.PARAMS, **(params or {})})
        raise _Stop

    monkeypatch.setattr(training, "prepared", lambda spark, sf_dir: (_Rows(), []))
    monkeypatch.setattr(modeling, "train_classifier", train)
    monkeypatch.setattr(modeling, "cv_scores", train)
    with pytest.raises(_Stop):
        training.QUERIES[name](None, "")
    assert used == [modeling.PARAMS] and modeling.PARAMS["rounds"] == 800


def test_rows_under_a_forest_lie_in_few_partitions(spark):
    rows = spark.range(300).selectExpr("id", "double(id) x", "int(id % 3) label").repartition(40)
    data = modeling._assembled(rows, ["x"], "label")
    assert data.rdd.getNumPartitions() == 1 and data.count() == 300
