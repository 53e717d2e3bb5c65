from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import boosting as b
from tallygrid.operators import modeling

PLAIN = {"depth": 2, "rounds": 1, "rate": 0.3, "rows": 1.0, "columns": 1.0, "child_weight": 0.5,
         "l1": 0.1, "l2": 1.0, "bins": 16}


def cases(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y, z = rng.normal(size=3)
        label = 0 if x + 0.3 * z < -0.4 else 1 if y < 0.2 else 2
        rows.append((i, float(x), float(round(y, 1)), float(z), label, i % 5))
    return rows


KIND = "id bigint, x double, y double, z double, label int, fold int"


def brute_split(values, g, h, p):
    """The best (gain, feature, cut) over all values of all features, by definition."""
    def strength(a, c):
        return max(abs(a) - p["l1"], 0.0) ** 2 / (c + p["l2"])

    best = (1e-6, None, None)
    for f in range(values.shape[1]):
        for cut in np.unique(values[:, f])[:-1]:
            left = values[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) < p["child_weight"]:
                continue
            gain = 0.5 * (strength(g[left].sum(), h[left].sum())
                          + strength(g[~left].sum(), h[~left].sum())
                          - strength(g.sum(), h.sum()))
            if gain > best[0] + 1e-7:
                best = (gain, f, cut)
    return best


def test_gradients_and_splits_of_twenty_rows_equal_brute_force(spark):
    p = {**b.PARAMS, **PLAIN, "bins": 256}
    rows = cases(20)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    model = b.fit_boosted(df, ["x", "y", "z"], params=p)[0]
    values = np.array([r[1:4] for r in rows])
    label = np.array([r[4] for r in rows])
    for k in range(3):
        # all margins are 0 before the first round: every class has a third
        g = 1 / 3 - (label == k)
        h = np.full(20, 2 / 3 * 2 / 3)
        def follow(node, mine, level):
            gain, f, cut = brute_split(values[mine], g[mine], h[mine], p)
            heap = (1 << level) - 1 + node
            if f is None or level == 2:
                leaf = node << (2 - level)
                want = -p["rate"] * np.sign(g[mine].sum()) * max(
                    abs(g[mine].sum()) - p["l1"], 0) / (h[mine].sum() + p["l2"])
                assert model.trees.value[0, k, leaf] == pytest.approx(want, abs=1e-5)
                return
            assert model.trees.feature[0, k, heap] == f
            assert model.trees.gain[0, k, heap] == pytest.approx(gain, abs=1e-4)
            left = values[:, f] <= cut
            bins = b.to_bins(values, model.cuts)
            assert ((bins[:, f] <= model.trees.cut[0, k, heap])[mine] == left[mine]).all()
            follow(2 * node, mine & left, level + 1)
            follow(2 * node + 1, mine & ~left, level + 1)
        follow(0, np.ones(20, bool), 0)


def test_partitions_do_not_change_a_model(spark, monkeypatch):
    monkeypatch.setattr(b, "TASK_ROWS", 10)
    monkeypatch.setattr(b, "PENDING", 2)
    df = spark.createDataFrame(cases(200), KIND)
    p = {"rounds": 6, "child_weight": 1.0}
    one = b.fit_boosted(df.coalesce(1), ["x", "y", "z"], key="id", params=p)[0]
    many = b.fit_boosted(df.repartition(7), ["x", "y", "z"], key="id", params=p)[0]
    for name in ("feature", "cut", "value"):
        assert (getattr(one.trees, name) == getattr(many.trees, name)).all()
    assert len(one.trees.feature) == 6


def test_learns_stops_and_scores(spark, tmp_path):
    df = spark.createDataFrame(cases(900), KIND)
    p = {"rounds": 400, "child_weight": 1.0, "rate": 0.3, "patience": 5}
    model = b.fit_boosted(df, ["x", "y", "z"], fold="fold", key="id", params=p)[0]
    kept = len(model.trees.feature)
    assert 0 < kept < 400 and len(model.losses) == kept + 6
    assert model.losses[kept] == min(model.losses)
    scored = model.transform(df.filter("fold = 0"))
    right = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.9
    assert model.importances.sum() == pytest.approx(1.0) and model.importances.min() > 0
    model.save(spark, f"{tmp_path}/m")
    again = b.BoostedModel.load(spark, f"{tmp_path}/m").transform(df.filter("fold = 0"))
    columns = ["id", "probability", "prediction"]
    assert again.select(columns).exceptAll(scored.select(columns)).count() == 0


def test_folds_side_by_side_equal_folds_alone(spark):
    df = spark.createDataFrame(cases(150), KIND)
    p = {"rounds": 4, "child_weight": 1.0}
    side = b.fit_boosted(df, ["x", "y"], fold="fold", models=5, key="id", params=p)
    # model 0 alone sees the same rows and draws the same columns
    alone = b.fit_boosted(df, ["x", "y"], fold="fold", models=1, key="id", params=p)[0]
    assert (side[0].trees.value == alone.trees.value).all()
    assert side[0].losses == alone.losses and side[1].losses != alone.losses


def test_defined_cases(spark):
    rows = [(i, float("nan") if i % 3 else 1.0 * i, None, 5.0, i % 3, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, KIND)
    model = b.fit_boosted(df, ["x", "y", "z"], params={"rounds": 3, "child_weight": 0.1})[0]
    scored = model.transform(df).collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in scored)
    with pytest.raises(ValueError):
        b.fit_boosted(df, [])
    with pytest.raises(ValueError):
        b.fit_boosted(df, ["x"], params={"bins": 300})


def test_kinds_of_the_classifier(spark, tmp_path):
    df = spark.createDataFrame(cases(120), KIND)
    quick = {"rounds": 3, "child_weight": 1.0}
    for kind in ("forest", "boosted"):
        model = modeling.train_classifier(df, ["x", "y"], params=quick, kind=kind)
        modeling.save_model(model, spark, f"{tmp_path}/{kind}")
        model = modeling.load_model(spark, f"{tmp_path}/{kind}")
        rows = modeling.batch_score(model, df, ["id"]).collect()
        assert len(rows) == 120
        assert all(abs(sum(r["probabilities"].values()) - 1) < 0.02 for r in rows)
        top = modeling.feature_importance(model, ["x", "y"]).collect()
        assert sum(r["importance"] for r in top) == pytest.approx(1.0)
        scores = modeling.cv_scores(df, ["x", "y"], params=quick, kind=kind).collect()
        assert sorted(r["fold"] for r in scores) == [0, 1, 2, 3, 4]


def test_a_matrix_of_one_task_takes_no_job_for_a_level(spark, monkeypatch):
    df = spark.createDataFrame(cases(200), KIND)
    p = {"rounds": 12, "child_weight": 1.0}

    def fit(group):
        spark.sparkContext.setJobGroup(group, group)
        model = b.fit_boosted(df, ["x", "y", "z"], fold="fold", key="id", params=p)[0]
        return model, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    one, jobs = fit("one task")
    monkeypatch.setattr(b, "TASK_ROWS", 10)
    many, passes = fit("many tasks")
    assert jobs < 12 <= passes
    for name in ("feature", "cut", "value", "gain"):
        assert (getattr(one.trees, name) == getattr(many.trees, name)).all()
    assert one.losses == many.losses


def test_blocks_of_a_task_are_one():
    blocks = [tuple(np.full(shape, i) for shape in (2, 2, 2, (2, 3), (2, 1, 3))) for i in range(4)]
    (one,) = b._joined(blocks)
    assert [a.shape for a in one] == [(8,), (8,), (8,), (8, 3), (8, 1, 3)]
    assert one[0].tolist() == [0, 0, 1, 1, 2, 2, 3, 3] and not list(b._joined([]))
