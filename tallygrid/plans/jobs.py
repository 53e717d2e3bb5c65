"""End-to-end jobs: training data, training, scoring, drift check, document index."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as words
from ..operators import bucketing, documents, drift, features, modeling
from ..schemas import COUNTY, COUNTY_FEATURES, FeatureSpec, Names
from ..sources import readers, sinks
from ..sources.keyed import KeyedTable

# Sums, means and maxima of the county mart, and the ratios of the feature table.
COUNTY_SUMS = (
    "fema_valid_registrations", "fema_total_damage", "fema_total_approved_ihp_amount",
    "fema_declaration_count", "fema_repair_replace_amount", "fema_rental_amount",
    "fema_other_needs_amount", "fema_total_inspected",
)
COUNTY_MEANS = (
    "population_total", "median_household_income", "median_home_value", "in_labor_force",
    "unemployed", "education_universe_total", "high_school_grad", "bachelors",
    "graduate_degree",
)
COUNTY_MAXIMA = ("nri_eal_score", "nri_risk_score", "nri_sovi_score", "nri_resl_score")
COUNTY_RATIOS = {
    "unemployment_rate": ("unemployed", "in_labor_force"),
    "bachelors_rate": ("bachelors", "education_universe_total"),
    "events_per_capita": ("noaa_event_count", "population_total"),
}
# Totals of the pivot under their county names.
COUNTY_TOTALS = {
    "all_events": "noaa_event_count",
    "all_severe": "noaa_total_fatalities",
    "all_minor": "noaa_total_injuries",
    "mean_damage": "noaa_avg_property_damage",
    "all_total_damage": "noaa_total_property_damage",
}


def county_features(
    mart: DataFrame, events: DataFrame, entity: DataFrame, names: Names = COUNTY
) -> DataFrame:
    """One wide row per county: the input of training and scoring."""
    base = features.feature_base(
        mart, entity, COUNTY_SUMS, COUNTY_MEANS, COUNTY_MAXIMA, names
    )
    pivot = features.category_pivot(
        events, words.COUNTY_FAMILIES, words.DAMAGE_FAMILIES, names
    ).withColumnsRenamed(COUNTY_TOTALS)
    return features.feature_table(base, pivot, COUNTY_RATIOS, names)


def write_training_data(
    table: DataFrame, folder: str, spec: FeatureSpec = COUNTY_FEATURES,
    source: str = "fema_total_damage", target: str = "risk_bucket", ratio: float = 0.8,
    seed: int = 42,
) -> None:
    """Tiers of ``source``, stratified split, ``train`` and ``test`` Parquet datasets."""
    spark = table.sparkSession
    if target not in table.columns:
        table = bucketing.tertile_bucket(table, source, spec.key, name=target)
    wanted = [spec.key, *spec.numeric, *spec.log, *spec.categorical, target]
    columns = list(dict.fromkeys(c for c in wanted if c in table.columns))
    # The wide table is read three times below; a written copy is cheaper than its plan.
    staged = f"{folder}/examples"
    sinks.write_dataset(features.drop_incomplete(table.select(*columns), target), staged)
    rows = spark.read.parquet(staged)
    split = bucketing.stratified_split(rows, target, spec.key, ratio, seed)
    sinks.write_dataset(split.filter("is_train").drop("is_train"), f"{folder}/train")
    sinks.write_dataset(split.filter("NOT is_train").drop("is_train"), f"{folder}/test")


@dataclass(frozen=True)
class Trained:
    model: modeling.Model
    fitted: features.FittedFeatures
    feature_names: list[str]
    metrics: dict[str, float]
    published: bool


def train(
    spark: SparkSession, folder: str, spec: FeatureSpec = COUNTY_FEATURES,
    target: str = "risk_bucket", params: Mapping[str, float] | None = None,
    kind: str = "forest", folds: int = 5, threshold: float = modeling.GATE,
) -> Trained:
    """Fit on ``train``, evaluate on ``test``; artefacts always, the model if good enough.

    Medians and levels come from the training rows and are applied to the test rows.
    """
    train_rows = spark.read.parquet(f"{folder}/train")
    test_rows = spark.read.parquet(f"{folder}/test")
    fitted = features.FeaturePipeline(spec).fit(train_rows)
    left, right = features.align_train_test(
        fitted.transform(train_rows), fitted.transform(test_rows)
    )
    skip = [c for c in spec.passthrough if c != target]
    coded, numeric = features.label_encode(left, target, skip)
    held, _ = features.label_encode(right, target, skip)
    coded = coded.persist()
    if folds > 1:
        folded = bucketing.stratified_folds(coded, "label", spec.key, folds)
        scores = modeling.cv_scores(folded, numeric, params=params, kind=kind, key=spec.key)
        sinks.write_json(scores, f"{folder}/cv")
    model = modeling.train_classifier(
        coded, numeric, params=params, kind=kind, judged=held, key=spec.key)
    coded.unpersist()
    predicted = model.transform(held).select("label", "prediction").persist()
    metrics = modeling.classification_metrics(predicted)
    sinks.write_json(metrics, f"{folder}/evaluation")
    sinks.write_json(modeling.classification_report(predicted), f"{folder}/report")
    classes = range(len(features.LABELS))
    grid = modeling.confusion_grid(modeling.confusion_matrix(predicted), classes)
    sinks.write_csv(grid.orderBy("actual"), f"{folder}/confusion")
    sinks.write_csv(modeling.feature_importance(model, numeric), f"{folder}/importance")
    published = modeling.quality_gate(metrics, threshold).first()["publish"]
    values = metrics.first().asDict()
    predicted.unpersist()
    fitted.save(spark, f"{folder}/features")
    if published:
        modeling.save_model(model, spark, f"{folder}/model")
    return Trained(model, fitted, numeric, values, published)


def score(
    table: DataFrame, model: modeling.Model, fitted: features.FittedFeatures,
    feature_names: Sequence[str], path: str, run_date: Column | str, model_name: str,
    describe: Sequence[str] = ("entity_name", "group_name", "county_name", "state"),
) -> DataFrame:
    """Tiers of all rows of a feature table, written under their run date.

    Columns that the table lacks count as 0.  The ``describe`` columns that it has, such as
    name and state, are written beside the key and the tier.
    """
    key = fitted.spec.key
    # Under other names, as a categorical column is replaced by its levels.
    shown = {f"_shown_{c}": c for c in describe if c in table.columns and c != key}
    beside = table.withColumns({own: F.col(c) for own, c in shown.items()}) if shown else table
    kept = [key, *shown]
    matrix = fitted.transform(beside, keep_incomplete=True, carry=kept)
    rows = features.align_features(matrix, feature_names, kept)
    scored = modeling.batch_score(model, rows, kept).withColumnsRenamed(shown)
    sinks.write_predictions(scored, path, run_date, model_name)
    return scored


def write_baseline(table: DataFrame, names: Sequence[str], folder: str) -> None:
    """Baseline moments and histograms of the training features."""
    long = drift.to_long(table, names)
    sinks.write_dataset(drift.baseline_stats(long), f"{folder}/moments")
    sinks.write_dataset(drift.histogram(long), f"{folder}/histogram")


def drift_check(
    spark: SparkSession, folder: str, capture_path: str, schema: T.StructType,
    names: Sequence[str], since: str | None = None, report_path: str | None = None,
    bad_lines_path: str | None = None,
) -> DataFrame:
    """One summary row; the report per feature and the bad lines are written if paths are given.

    The window is read once for the report; its bad lines are counted in the same pass and read
    again only to be written.
    """
    captured = readers.read_capture_window(spark, capture_path, schema, since)
    histogram = spark.read.parquet(f"{folder}/histogram")
    known = [n for n in names if n in captured.rows.columns]
    counts = drift.binned_counts(drift.to_long(captured.rows, known), histogram)
    checked = counts.collect() if known else []  # one row per feature
    if not known:
        captured.rows.agg(F.count("*")).collect()
    bad_lines = captured.counts()["bad_lines"]
    if bad_lines and bad_lines_path:
        sinks.write_dataset(captured.bad, bad_lines_path)
    if not checked:
        return spark.range(1).select(
            F.lit(0).cast("bigint").alias("total_features_checked"),
            F.array().cast("array<string>").alias("drifted_features"),
            F.lit(False).alias("drift_detected"),
            F.lit("no_capture_data").alias("reason"),
            F.lit(bad_lines).cast("bigint").alias("bad_lines"),
        )
    counts = spark.createDataFrame(checked, counts.schema)
    report = drift.report_of(counts, spark.read.parquet(f"{folder}/moments"), histogram)
    if report_path:
        sinks.write_json(report, report_path)
        report = spark.read.schema(report.schema).json(report_path)
    return drift.drift_summary(report).withColumns({
        "reason": F.lit(None).cast("string"), "bad_lines": F.lit(bad_lines).cast("bigint")})


def index_corpus(
    spark: SparkSession, corpus: str, table: str, size: int = 512, overlap: int = 64,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Chunk a folder and upsert the chunks into a table; reruns replace the same ids.

    ``enrich`` may add columns, such as an embedding, to the tagged chunks.
    """
    docs = readers.read_corpus(spark, corpus)
    chunks = documents.tag_chunks(documents.chunk_documents(docs, "source", "text", size, overlap))
    new = enrich(chunks) if enrich else chunks
    keyed = KeyedTable(spark, table, "id")
    keyed.upsert(new)
    return keyed.read()
