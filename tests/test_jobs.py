"""Sources, sinks, whole jobs and streams on temporary folders."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.operators import bucketing, drift, modeling
from tallygrid.plans import jobs
from tallygrid.schemas import FeatureSpec
from tallygrid.sources import readers, sinks
from tallygrid.streaming import capture

from .conftest import dicts

CAPTURE = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("a", T.DoubleType()),
        T.StructField("b", T.DoubleType()),
    ]
)


def write_lines(path, rows, junk=True):
    lines = [json.dumps(r) for r in rows] + (["{not json", ""] if junk else [])
    path.write_text("\n".join(lines))


def capture_rows(day, n, shift=0.0, seed=0):
    rng = np.random.default_rng(seed)
    return [
        {"ts": f"2024-01-{day:02d}T{i % 24:02d}:00:00Z", "a": float(rng.normal() + shift),
         "b": float(rng.normal())}
        for i in range(n)
    ]


def test_capture_skips_bad_lines_and_applies_the_cutoff(spark, tmp_path):
    write_lines(tmp_path / "x.json", capture_rows(1, 5) + capture_rows(3, 4))
    folder = str(tmp_path)
    assert readers.capture_json(spark, folder, CAPTURE).count() == 9
    assert readers.capture_json(spark, folder, CAPTURE, "2024-01-02").count() == 4


def test_parquet_parts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        readers.read_parquet_parts(spark, str(tmp_path / "none"))
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "many"))
    assert readers.read_parquet_parts(spark, str(tmp_path / "many")).count() == 10
    with pytest.raises(ValueError):
        readers.union_parts([])


def test_result_csv_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "r.csv").write_text("county_fips,n\n01001,5\n48201,\n")
    schema = "county_fips string, n int"
    rows = readers.read_result_csv(spark, str(tmp_path / "r.csv"), schema).collect()
    assert [tuple(r) for r in rows] == [("01001", 5), ("48201", None)]


def test_numeric_coercion_is_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1", ""), ("2.5", "x", ""), ("", "3", "")],
                               "n string, mixed string, blank string")
    out = readers.coerce_numeric(df)
    kinds = dict(out.dtypes)
    assert (kinds["n"], kinds["mixed"]) == ("double", "string")
    assert [r["n"] for r in out.collect()] == [1.0, 2.5, None]


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_bytes(b"good \xff bytes")
    (tmp_path / "deep" / "B.MD").write_text("# title")
    (tmp_path / "c.pdf").write_text("not read")
    (tmp_path / "blank.txt").write_text(" \n ")
    rows = {r["source"].rsplit("/", 1)[1]: r["text"]
            for r in readers.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "good � bytes", "B.MD": "# title"}


def test_prediction_partitions_replace_only_their_date(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_predictions(spark.range(3), path, "2024-01-01", "m")
    sinks.write_predictions(spark.range(5), path, "2024-01-02", "m")
    sinks.write_predictions(spark.range(1), path, "2024-01-01", "m")
    counts = {str(r["run_date"]): r["count"] for r in
              spark.read.parquet(path).groupBy("run_date").count().collect()}
    assert counts == {"2024-01-01": 1, "2024-01-02": 5}


def test_run_date(spark):
    moment = F.lit("2024-05-06 01:02:03").cast("timestamp")
    assert spark.range(1).select(sinks.run_date_of(moment)).first()[0] == "2024-05-06"


def test_index_is_idempotent(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "a.txt").write_text("flood " * 1000)
    (corpus / "b.md").write_text("hail storms")
    table = str(tmp_path / "index")
    first = jobs.index_corpus(spark, str(corpus), table)
    before = {(r["id"], r["text"], r["tag"]) for r in first.collect()}
    again = jobs.index_corpus(spark, str(corpus), table)
    assert {(r["id"], r["text"], r["tag"]) for r in again.collect()} == before
    (corpus / "b.md").write_text("tornado season")
    changed = jobs.index_corpus(spark, str(corpus), table).collect()
    assert len(changed) == len(before)
    assert "tornado" in {r["tag"] for r in changed} and "hail" not in {r["tag"] for r in changed}


SPEC = FeatureSpec(
    numeric=("x", "y"), log=("y",), categorical=("state",), key="k", drop=(),
    passthrough=("k", "risk_bucket", "damage"),
)


@pytest.fixture(scope="module")
def table(spark):
    """Damage follows x; y is noise with gaps; a third of the damages are zero."""
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    x = F.col("id") % 90
    return spark.range(360).select(
        F.col("id").alias("k"),
        x.cast("double").alias("x"),
        F.when(F.col("id") % 11 != 0, noise).alias("y"),
        F.when(x < 25, 0.0).otherwise(x * 1000.0).alias("damage"),
        F.when(F.col("id") % 2 == 0, "Texas").otherwise("Ohio").alias("state"),
    )


@pytest.fixture(scope="module")
def trained(spark, table, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("train"))
    jobs.write_training_data(table, folder, SPEC, source="damage")
    result = jobs.train(
        spark, folder, SPEC, params={"rounds": 8, "columns": 1.0}, folds=3
    )
    return folder, result


def test_training_job(spark, trained):
    folder, result = trained
    assert result.published and result.metrics["balanced_accuracy"] > 0.9
    assert result.feature_names == ["x", "y", "y_log", "state_Texas"]
    train = spark.read.parquet(f"{folder}/train")
    assert "damage" not in train.columns
    assert train.count() == 288 and spark.read.parquet(f"{folder}/test").count() == 72
    assert spark.read.json(f"{folder}/cv").count() == 3
    assert spark.read.json(f"{folder}/evaluation").count() == 1
    assert spark.read.option("header", True).csv(f"{folder}/confusion").count() == 3
    modeling.PipelineModel.load(f"{folder}/model")


def test_gate_withholds_a_poor_model(spark, trained, tmp_path):
    folder, _ = trained
    other = str(tmp_path / "gate")
    for part in ("train", "test"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{other}/{part}")
    result = jobs.train(spark, other, SPEC, params={"rounds": 2}, folds=0, threshold=1.01)
    assert not result.published
    assert not (tmp_path / "gate" / "model").exists()


def test_scoring_job(spark, trained, table, tmp_path):
    _, result = trained
    path = str(tmp_path / "scores")
    gaps = table.withColumn("state", F.lit("Utah"))
    jobs.score(gaps, result.model, result.fitted, result.feature_names, path, "2024-01-01", "m")
    rows = spark.read.parquet(path)
    assert rows.count() == 360
    assert set(rows.columns) == {
        "k", "state", "predicted_class", "risk_bucket", "probabilities", "model", "run_date"
    }
    assert {r["state"] for r in rows.collect()} == {"Utah"}
    lacking = jobs.score(table.drop("state"), result.model, result.fitted, result.feature_names,
                         str(tmp_path / "lacking"), "2024-01-01", "m")
    assert lacking.count() == 360 and "state" not in lacking.columns


def test_drift_job(spark, tmp_path):
    base, recent, empty = tmp_path / "base", tmp_path / "recent", tmp_path / "empty"
    for folder in (base, recent, empty):
        folder.mkdir()
    write_lines(base / "x.json", capture_rows(1, 300, seed=1))
    write_lines(recent / "x.json", capture_rows(2, 300, shift=3.0, seed=2))
    write_lines(empty / "x.json", [])
    store = str(tmp_path / "store")
    jobs.write_baseline(readers.capture_json(spark, str(base), CAPTURE), ["a", "b"], store)
    row = jobs.drift_check(
        spark, store, str(recent), CAPTURE, ["a", "b"], report_path=str(tmp_path / "report")
    ).first()
    assert "a" in row["drifted_features"] and row["total_features_checked"] == 2
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    nothing = jobs.drift_check(spark, store, str(empty), CAPTURE, ["a", "b"]).first()
    assert nothing["reason"] == "no_capture_data" and not nothing["drift_detected"]


# -- streams ------------------------------------------------------------------------------


@pytest.fixture()
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    write_lines(folder / "1.json", capture_rows(1, 40, seed=1))
    write_lines(folder / "2.json", capture_rows(2, 60, seed=2))
    return folder


def test_stream_ingest_equals_batch_and_resumes(spark, inbox, tmp_path):
    table, mark = str(tmp_path / "t"), str(tmp_path / "c")

    def run():
        stream = capture.read_capture(spark, str(inbox), CAPTURE, 1)
        capture.ingest_capture(stream, table, mark).awaitTermination()

    run()
    assert spark.read.parquet(table).count() == 100
    write_lines(inbox / "3.json", capture_rows(3, 10, seed=3))
    run()
    batch = readers.capture_json(spark, str(inbox), CAPTURE)
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == sorted(
        map(tuple, batch.collect())
    )


def test_stream_daily_stats_equal_batch(spark, inbox, tmp_path):
    write_lines(inbox / "9.json", capture_rows(9, 1), junk=False)

    def long(df):
        return df.select("ts", F.lit("a").alias("feature"), F.col("a").alias("value"))

    stats = capture.daily_feature_stats(long(capture.read_capture(spark, str(inbox), CAPTURE)))
    query = (
        stats.writeStream.format("memory").queryName("daily").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = capture.daily_feature_stats(long(readers.capture_json(spark, str(inbox), CAPTURE)))
    closed = {(r["day"], r["rows"]): r["mean"] for r in spark.table("daily").collect()}
    every = {(r["day"], r["rows"]): r["mean"] for r in batch.collect()}
    # the last day is still open when the input ends
    assert len(closed) == 2 and len(every) == 3
    for key, mean in closed.items():
        assert every[key] == pytest.approx(mean)


def test_late_rows_are_dropped(spark, tmp_path):
    inbox = tmp_path / "late"
    inbox.mkdir()

    def run():
        stream = capture.read_capture(spark, str(inbox), CAPTURE)
        long = stream.select("ts", F.lit("a").alias("feature"), F.col("a").alias("value"))
        capture.daily_feature_stats(long).writeStream.format("parquet").outputMode("append") \
            .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True) \
            .start(str(tmp_path / "out")).awaitTermination()

    write_lines(inbox / "1.json", capture_rows(1, 24) + capture_rows(9, 1), junk=False)
    run()
    write_lines(inbox / "2.json", capture_rows(1, 24) + capture_rows(20, 1), junk=False)
    run()
    rows = dicts(spark.read.parquet(str(tmp_path / "out")).orderBy("day"))
    assert [r["rows"] for r in rows] == [24, 1]


@pytest.mark.parametrize("files", [1, 12])
def test_stream_drift_does_not_depend_on_batches(spark, inbox, tmp_path, files):
    """Twelve files of six rows: alone none has the ten rows that a check needs."""
    store = str(tmp_path / "store")
    jobs.write_baseline(readers.capture_json(spark, str(inbox), CAPTURE), ["a", "b"], store)
    shifted = tmp_path / "new"
    shifted.mkdir()
    for i in range(12):
        write_lines(shifted / f"{i}.json", capture_rows(5, 6, shift=i / 4, seed=i))
    stream = capture.read_capture(spark, str(shifted), CAPTURE, 12 // files)
    out = str(tmp_path / "report")
    capture.stream_drift(
        stream, ["a", "b", "absent"], f"{store}/moments", f"{store}/histogram", out,
        str(tmp_path / "c"),
    ).awaitTermination()
    rows = drift.to_long(readers.capture_json(spark, str(shifted), CAPTURE), ["a", "b"])
    twin = drift.drift_report(
        rows, spark.read.parquet(f"{store}/moments"), spark.read.parquet(f"{store}/histogram"))

    def shown(report):
        return sorted((r["feature"], r["kl_divergence"], r["is_drifted"], r["mean_shift"],
                       round(r["recent_mean"], 9)) for r in report.collect())

    assert shown(spark.read.parquet(out)) == shown(twin) and len(shown(twin)) == 2


def test_stream_drift_by_window(spark, inbox, tmp_path):
    """A report per closed day; the day that may still grow has none yet."""
    store = str(tmp_path / "store")
    jobs.write_baseline(readers.capture_json(spark, str(inbox), CAPTURE), ["a", "b"], store)
    new = tmp_path / "new"
    new.mkdir()
    for i, day in enumerate((3, 4, 3, 9)):
        write_lines(new / f"{i}.json", capture_rows(day, 8, seed=i))
    out = str(tmp_path / "report")
    capture.stream_drift(
        capture.read_capture(spark, str(new), CAPTURE, 1), ["a"], f"{store}/moments",
        f"{store}/histogram", out, str(tmp_path / "c"), window="1 day", delay="2 days",
    ).awaitTermination()
    rows = spark.read.parquet(out).collect()
    # eight rows of the fourth are too few, the third has sixteen
    assert [r["window_start"].day for r in rows] == [3]
    day = readers.capture_json(spark, str(new), CAPTURE).filter(F.dayofmonth("ts") == 3)
    twin = drift.drift_report(
        drift.to_long(day, ["a"]), spark.read.parquet(f"{store}/moments"),
        spark.read.parquet(f"{store}/histogram")).first()
    assert rows[0]["kl_divergence"] == twin["kl_divergence"]


def test_capture_window_prunes_days_and_keeps_bad_lines(spark, tmp_path):
    folder = tmp_path / "capture"
    for day in (1, 2, 3):
        part = folder / f"date=2024-01-0{day}"
        part.mkdir(parents=True)
        write_lines(part / "x.json", capture_rows(day, 5, seed=day))
    with open(folder / "date=2024-01-02" / "y.json", "w") as f:
        f.write('{"ts": "2024-01-02T0\n\n   \n[1]\nnull\n{"a": "x"}\n')
    with open(folder / "date=2024-01-01" / "z.json", "w") as f:
        f.write("not asked for\n")
    window = readers.read_capture_window(
        spark, str(folder), CAPTURE, "2024-01-02T00:00:00", "2024-01-03T00:00:00")
    plan = window.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert window.rows.columns == CAPTURE.names
    assert {r["ts"].day for r in window.rows.collect()} == {2}
    counts = window.counts()
    assert counts["good_lines"] == 5 and counts["lines"] == 5 + counts["bad_lines"]
    bad = window.bad.collect()
    assert len(bad) == counts["bad_lines"] and {str(r["date"]) for r in bad} == {"2024-01-02"}
    assert '{"a": "x"}' in {r["line"] for r in bad if r["file"].endswith("y.json")}
    flat = readers.read_capture_window(spark, str(folder / "date=2024-01-03"), CAPTURE)
    assert flat.rows.count() == 5 and flat.counts()["bad_lines"] == 1
    assert [r["line"] for r in flat.bad.collect()] == ["{not json"]


def test_stream_scores(spark, trained, table, tmp_path):
    _, result = trained
    matrix = result.fitted.transform(table, keep_incomplete=True).select(
        "k", *result.feature_names
    )
    source = str(tmp_path / "in")
    matrix.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(matrix.schema).option("maxFilesPerTrigger", 1) \
        .parquet(source)
    out = str(tmp_path / "scores")
    capture.stream_scores(
        stream, result.model, ["k"], out, "m", str(tmp_path / "c"), "2024-01-01"
    ).awaitTermination()
    streamed = {(r["k"], r["predicted_class"]) for r in spark.read.parquet(out).collect()}
    batch = modeling.batch_score(result.model, matrix, ["k"])
    assert streamed == {(r["k"], r["predicted_class"]) for r in batch.collect()}


def test_tied_damages_fall_back_to_ranks(table):
    tiers = bucketing.tertile_bucket(
        table.withColumn("damage", F.when(F.col("x") > 60, F.col("damage")).otherwise(0.0)),
        "damage", "k",
    )
    counts = {r["risk_bucket"]: r["count"] for r in
              tiers.groupBy("risk_bucket").count().collect()}
    assert counts == {"LOW": 120, "MEDIUM": 120, "HIGH": 120}
