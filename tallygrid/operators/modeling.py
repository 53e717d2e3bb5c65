"""Tier classifier: training, cross-validation, scoring, evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import first_argmax, rounded
from .boosting import PARAMS, BoostedModel, fit_boosted
from .features import LABELS

# Models of one cross-validation that train at the same time.
SIDE_BY_SIDE = 4
# Rows that a partition under a forest should have at most, and at least.
TASK_ROWS = 500_000
LEAST_ROWS = 10_000
GATE = 0.60

Model = PipelineModel | BoostedModel


def train_classifier(
    df: DataFrame, features: Sequence[str], label: str = "label",
    params: Mapping[str, float] | None = None, kind: str = "forest",
    judged: DataFrame | None = None, key: str | None = None,
) -> Model:
    """Three-class tree ensemble: a random forest, or boosted trees with one softmax.

    Boosting stops early by its loss on ``judged`` rows, if there are any.
    """
    p = {**PARAMS, **(params or {})}
    if kind == "boosted":
        kept = [*dict.fromkeys([*features, label, *([key] if key else [])])]
        rows, fold = df.select(*kept), None
        if judged is not None:
            fold = "_judged"
            rows = rows.withColumn(fold, F.lit(-1)).unionByName(
                judged.select(*kept).withColumn(fold, F.lit(0)))
        return fit_boosted(rows, features, label, fold, 1, len(LABELS), key, p)[0]
    if kind != "forest":
        raise ValueError(f"kind must be 'forest' or 'boosted', not {kind!r}")
    data = _assembled(df, features, label).select("features", label)
    return _forest(data, features, label, p)


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def _assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows with their vector, in as many partitions as their number is worth.

    Every pass of a forest sends all nodes' histograms from every partition, however few rows
    it has: some 130 MB for 800 trees of depth 4 over 43 features.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, rows // TASK_ROWS, min(cores, rows // LEAST_ROWS))
    return _assembler(features).transform(
        df.withColumn(label, F.col(label).cast("double")).repartition(tasks))


def _forest(
    data: DataFrame, features: Sequence[str], label: str, p: Mapping[str, float]
) -> PipelineModel:
    estimator = RandomForestClassifier(
        labelCol=label, maxDepth=int(p["depth"]), numTrees=int(p["rounds"]),
        subsamplingRate=p["rows"], featureSubsetStrategy=str(p["columns"]), seed=int(p["seed"]),
    )
    return PipelineModel([_assembler(features), estimator.fit(data)])


def save_model(model: Model, spark: SparkSession, path: str) -> None:
    """The model under ``path``, in place of an earlier one."""
    if isinstance(model, BoostedModel):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """A model of either kind; a forest's folder has a ``metadata`` folder of its own."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path, "metadata")
    forest = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
    return PipelineModel.load(path) if forest else BoostedModel.load(spark, path)


def batch_score(
    model: Model, df: DataFrame, keep: Sequence[str], labels: Sequence[str] = LABELS
) -> DataFrame:
    """Class, tier and rounded probabilities per row, in the executors."""
    scored = model.transform(df)
    probabilities = F.col("probability")
    if not isinstance(model, BoostedModel):
        probabilities = vector_to_array("probability")
    predicted = first_argmax(probabilities)
    names = F.array(*[F.lit(n) for n in labels])
    return scored.select(
        *keep,
        predicted.alias("predicted_class"),
        names[predicted].alias("risk_bucket"),
        F.map_from_arrays(
            names, F.transform(probabilities, lambda p: rounded(p, 2))
        ).alias("probabilities"),
    )


def confusion_matrix(
    pred: DataFrame, label: str = "label", predicted: str = "prediction"
) -> DataFrame:
    """Rows per (actual, predicted) pair."""
    return pred.groupBy(
        F.col(label).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")
    ).agg(F.count("*").alias("rows"))


def confusion_grid(matrix: DataFrame, classes: Sequence[int]) -> DataFrame:
    """One row per actual class and one count column per predicted class."""
    return matrix.groupBy("actual").agg(
        *[
            F.sum(F.when(F.col("predicted") == c, F.col("rows")).otherwise(0)).alias(
                f"predicted_{c}"
            )
            for c in classes
        ]
    )


def classification_report(
    pred: DataFrame, label: str = "label", predicted: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs on either side."""
    matrix = confusion_matrix(pred, label, predicted)
    hit = F.col("actual") == F.col("predicted")
    # Each cell counts once for its actual and once for its predicted class.
    sides = matrix.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("class"),
                    F.col("rows").alias("support"),
                    F.lit(0).cast("bigint").alias("called"),
                    F.when(hit, F.col("rows")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("rows").alias("called"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        F.sum("support").alias("support"),
        F.sum("called").alias("called"),
        F.sum("hits").alias("hits"),
    )
    hits, called, support = (F.col(c).cast("double") for c in ("hits", "called", "support"))
    zero = F.lit(0.0)
    return sums.select(
        "class",
        F.coalesce(F.try_divide(hits, called), zero).alias("precision"),
        F.coalesce(F.try_divide(hits, support), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * hits, called + support), zero).alias("f1"),
        "support",
        "hits",
    )


def classification_metrics(
    pred: DataFrame, label: str = "label", predicted: str = "prediction"
) -> DataFrame:
    """One row: accuracy, balanced accuracy, weighted F1, macro F1."""
    support = F.col("support").cast("double")
    return classification_report(pred, label, predicted).agg(
        (F.sum("hits").cast("double") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum(F.col("f1") * support) / F.sum(support)).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
    )


def quality_gate(metrics: DataFrame, threshold: float = GATE) -> DataFrame:
    """May the model be published?"""
    return metrics.select(
        "balanced_accuracy",
        F.lit(threshold).alias("threshold"),
        (F.col("balanced_accuracy") >= threshold).alias("publish"),
    )


def bucket_distribution(pred: DataFrame, bucket: str = "risk_bucket") -> DataFrame:
    """Rows per predicted tier."""
    return pred.groupBy(bucket).agg(F.count("*").alias("rows"))


def feature_importance(
    model: Model, features: Sequence[str], limit: int = 20
) -> DataFrame:
    """Importance per feature, largest first; the model's own list, so driver-sized."""
    if isinstance(model, BoostedModel):
        shares = model.importances
    else:
        shares = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(features, shares, strict=True)]
    return (
        SparkSession.active()
        .createDataFrame(rows, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
        .limit(limit)
    )


def cv_scores(
    df: DataFrame, features: Sequence[str], fold: str = "fold", label: str = "label",
    params: Mapping[str, float] | None = None, kind: str = "forest", key: str | None = None,
) -> DataFrame:
    """Balanced accuracy and rows per held-out fold, with mean and population std over the folds.

    Folds train side by side over one cached matrix: boosted models share every pass over it,
    forests share the session.  Rows without a fold are always learnt from.
    """
    p = {**PARAMS, **(params or {})}
    spark = df.sparkSession
    numbers = df.select(fold).filter(F.col(fold).isNotNull()).distinct().orderBy(fold)
    folds = [r[0] for r in numbers.collect()]
    kept = [*dict.fromkeys([*features, label, fold, *([key] if key else [])])]
    data = _assembled(df.select(*kept), features, label).persist()
    if kind == "boosted":
        place = F.element_at(
            F.create_map(*[F.lit(v) for i, f in enumerate(folds) for v in (f, i)]), F.col(fold))
        # a fold must not decide when the model that it judges stops
        models = fit_boosted(data.withColumn("_place", place), features, label, "_place",
                             len(folds), len(LABELS), key, {**p, "patience": float("inf")})
        models = dict(zip(folds, models, strict=True))
    elif kind != "forest":
        raise ValueError(f"kind must be 'forest' or 'boosted', not {kind!r}")

    def judged(f) -> tuple[int, float, int]:
        out = F.col(fold).eqNullSafe(F.lit(f))
        model = (models[f] if kind == "boosted"
                 else _forest(data.filter(~out).select("features", label), features, label, p))
        held = model.transform(data.filter(out).drop("features"))
        score = classification_report(held.select(label, "prediction"), label).agg(
            F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.sum("support")).first()
        return int(f), float(score[0]), int(score[1])

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        per_fold = list(pool.map(inheritable_thread_target(spark)(judged), folds))
    data.unpersist()
    scores = spark.createDataFrame(per_fold, "fold int, balanced_accuracy double, rows bigint")
    mean, std = scores.agg(
        F.avg("balanced_accuracy"), F.stddev_pop("balanced_accuracy")).first()
    return scores.withColumns(
        {"mean": F.lit(mean).cast("double"), "std": F.lit(std).cast("double")})
