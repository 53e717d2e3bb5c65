"""Order statistics, quantiles, ranks, tiers, splits: against numpy on the same values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.functions import selection, sizing
from tallygrid.operators import bucketing, features

from .conftest import dicts

PROBS = [0.0, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """30 000 rows: one hot group with many ties, one with distinct values, a tiny one."""
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(20_000) < 0.4, 0.0, np.round(rng.lognormal(3, 2, 20_000), 2))
    wide = rng.normal(size=10_000) * 1e6
    tiny = np.array([3.0, 1.0, 2.0])
    rows = [("hot", float(v)) for v in hot] + [("wide", float(v)) for v in wide]
    rows += [("tiny", float(v)) for v in tiny] + [("tiny", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    return df.persist(), {"hot": hot, "wide": wide, "tiny": tiny}


def test_order_statistics_match_numpy(skewed):
    df, values = skewed
    got = selection.order_statistics(df, ["g"], "v", PROBS, accuracy=1_000)
    for row in got.collect():
        expected = np.quantile(values[row["g"]], PROBS[row["target"]])
        assert row["statistic"] == pytest.approx(expected, rel=1e-12)
        assert row["n"] == len(values[row["g"]])
    assert got.count() == 3 * len(PROBS)


def test_ungrouped_quantiles(skewed):
    df, values = skewed
    row = selection.exact_quantiles(df, [], "v", [0.1, 0.5], ["a", "b"]).first()
    every = np.concatenate(list(values.values()))
    assert row["a"] == pytest.approx(np.quantile(every, 0.1))
    assert row["b"] == pytest.approx(np.quantile(every, 0.5))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert selection.order_statistics(empty, ["g"], "v", [0.5]).count() == 0
    rows = selection.order_statistics(empty, [], "v", [0.5]).collect()
    assert [(r["n"], r["statistic"]) for r in rows] == [(0, None)]


def test_null_groups_and_groups_without_values_are_kept(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("a", None), ("b", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["m"]) for r in selection.exact_quantiles(df, ["g"], "v", [0.5], ["m"]).collect()}
    assert got == {None: 2.0, "a": None, "b": 5.0}


def test_wide_brackets_are_narrowed(skewed, monkeypatch):
    df, values = skewed
    monkeypatch.setattr(selection, "BRACKET_ROWS", 1)
    got = selection.order_statistics(df, ["g"], "v", PROBS, accuracy=1_000)
    for row in got.collect():
        expected = np.quantile(values[row["g"]], PROBS[row["target"]])
        assert row["statistic"] == pytest.approx(expected, rel=1e-12)


def test_running_total_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(selection, "BOUND_ROWS", 50)
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit(2).alias("w"))
    rows = selection.running_total(df, ["k"], "w", "t").collect()
    assert all(r["t"] == 2 * r["k"] for r in rows) and len(rows) == 500


def test_global_rank_is_a_total_order(skewed):
    df, _ = skewed
    keyed = df.filter("v IS NOT NULL").withColumn("k", F.monotonically_increasing_id())
    ranked = selection.global_rank(keyed, ["v", "k"])
    rows = ranked.select("v", "k", "rank").collect()
    ordered = sorted(rows, key=lambda r: (r["v"], r["k"]))
    assert [r["rank"] for r in ordered] == list(range(1, len(rows) + 1))


def test_medians(skewed):
    df, values = skewed
    wide = df.withColumn("w", F.col("v") * 2)
    every = np.concatenate(list(values.values()))
    medians = features.column_medians(wide, ["v", "w", "absent"])
    assert medians["v"] == pytest.approx(np.median(every))
    assert medians["w"] == pytest.approx(np.median(every) * 2)


@pytest.mark.parametrize(("n", "sizes"), [(4, (2, 1, 1)), (7, (3, 2, 2)), (10, (4, 3, 3)),
                                          (100, (34, 33, 33))])
def test_rank_tiers_have_the_known_sizes(spark, n, sizes):
    df = spark.range(n).select(F.col("id").alias("k"), F.lit(0.0).alias("v"))
    rows = dicts(bucketing.tertile_bucket(df, "v", "k"))
    counts = [sum(r["risk_bucket"] == t for r in rows) for t in ("LOW", "MEDIUM", "HIGH")]
    assert tuple(counts) == sizes
    # ties go by key
    assert {r["k"] for r in rows if r["risk_bucket"] == "LOW"} == set(range(sizes[0]))


def test_value_tiers_are_right_closed(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)] + [(9, None)], "k int, v double")
    rows = {r["k"]: r["risk_bucket"] for r in bucketing.tertile_bucket(df, "v", "k").collect()}
    assert [rows[i] for i in range(7)] == ["LOW"] * 3 + ["MEDIUM"] * 2 + ["HIGH"] * 2
    assert rows[9] is None


@pytest.fixture(scope="module")
def strata(spark):
    """Two thirds of all rows are in one stratum."""
    stratum = F.when(F.col("id") % 3 < 2, "big").when(F.col("id") < 60, "small").otherwise("mid")
    return spark.range(3_000).select("id", stratum.alias("s"))


@pytest.mark.parametrize("hasher", [bucketing.fast_hash, bucketing.portable_hash])
def test_hashes_fit_a_double_and_differ_by_salt(spark, hasher):
    rows = spark.range(2_000).select(
        hasher(F.col("id"), "a").alias("a"), hasher(F.col("id"), "b").alias("b")
    ).collect()
    assert all(0 <= r["a"] < 2**52 for r in rows)
    assert len({r["a"] for r in rows}) == 2_000
    assert sum(r["a"] == r["b"] for r in rows) == 0
    assert 0.4 < sum(r["a"] < 2**51 for r in rows) / 2_000 < 0.6


def test_split_is_exact_per_stratum_and_repeatable(strata):
    first = bucketing.stratified_split(strata, "s", "id", 0.8, 42)
    counts = first.groupBy("s").agg(
        F.count("*").alias("n"), F.count_if("is_train").alias("train")
    )
    for r in counts.collect():
        assert r["train"] == int(r["n"] * 0.8 + 0.5)
    again = bucketing.stratified_split(strata.repartition(7), "s", "id", 0.8, 42)
    chosen = {r["id"] for r in first.filter("is_train").collect()}
    assert chosen == {r["id"] for r in again.filter("is_train").collect()}
    other = bucketing.stratified_split(strata, "s", "id", 0.8, 43)
    assert chosen != {r["id"] for r in other.filter("is_train").collect()}


def test_rows_without_a_stratum_are_a_stratum(spark):
    df = spark.range(20).select("id", F.when(F.col("id") < 10, "a").alias("s"))
    split = bucketing.stratified_split(df, "s", "id", 0.8)
    assert {r["s"]: r["n"] for r in split.filter("is_train").groupBy("s").agg(
        F.count("*").alias("n")).collect()} == {"a": 8, None: 8}
    folds = bucketing.stratified_folds(df, "s", "id", 5).groupBy("s", "fold").count().collect()
    assert len(folds) == 10 and all(r["count"] == 2 for r in folds)


def test_folds_share_every_stratum_evenly(strata):
    rows = bucketing.stratified_folds(strata, "s", "id", 5).groupBy("s", "fold").count()
    for stratum in ("big", "mid", "small"):
        sizes = [r["count"] for r in rows.filter(F.col("s") == stratum).collect()]
        assert len(sizes) == 5
        assert max(sizes) - min(sizes) <= 1


def test_folds_are_independent_of_the_split(strata):
    both = bucketing.stratified_folds(
        bucketing.stratified_split(strata, "s", "id"), "s", "id", 5
    )
    per_fold = both.filter("is_train").groupBy("fold").count().collect()
    assert len(per_fold) == 5
    assert all(400 < r["count"] < 560 for r in per_fold)


def test_bounded_side_keeps_all_rows_beyond_its_bound(spark):
    df = spark.range(50)
    assert sizing.bounded_side(df, 10).count() == 50
    assert sizing.bounded_side(df, 50).count() == 50
    assert sizing.plan_bytes(df) > 0


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_ranges_of_any_number_and_type(spark, parts, monkeypatch):
    monkeypatch.setattr(selection, "BOUND_ROWS", 200)
    rows = [(None if i % 7 == 0 else f"w'{i % 13}\\", i * 0.1, i) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, d double, k int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["k"]: (r["b"], r["t"]) for r in selection.running_total(
            df, ["s", "d", "k"], "k", "b", "t").collect()}
        placed = selection._ranges(df, ["s", "d", "k"])
        assert placed.select("_part").distinct().count() in range(max(1, parts // 2), 2 * parts + 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total, want = sum(r[2] for r in rows), 0
    for s, d, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        assert got[k] == (want, total)
        want += k
