"""Feature table building and the fit/transform feature pipeline."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numeric import guarded_ratio, mean, zero_if_null
from ..functions.selection import exact_quantiles
from ..schemas import FeatureSpec, Names




def feature_base(
    mart: DataFrame, entity: DataFrame, sums: Sequence[str], means: Sequence[str],
    maxima: Sequence[str], names: Names = Names(),
) -> DataFrame:
    """One row per scored entity: sums, means and maxima over all years, plus its group.

    Entities missing from the dimension stay, with a NULL group.
    """
    rolled = (
        mart.filter(F.col(names.loss).isNotNull())
        .groupBy(names.entity)
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            *[mean(F.col(c)).alias(c) for c in means],
            *[F.max(c).alias(c) for c in maxima],
        )
    )
    return rolled.join(entity.select(names.entity, names.group), names.entity, "left")


def category_pivot(
    events: DataFrame, families: Mapping[str, Sequence[str]], with_damage: Sequence[str],
    names: Names = Names(),
) -> DataFrame:
    """Per entity: totals, and per family of categories an event count and a damage sum.

    One pass of conditional sums.  Families may overlap, which a pivot cannot express.
    """
    category, count = F.col(names.category), F.col(names.event_count)
    damage = count.cast("double") * F.coalesce(
        F.col(names.event_avg_damage).cast("double"), F.lit(0.0)
    )
    columns: list[Column] = []
    for family, members in families.items():
        hit = category.isin(list(members))
        columns.append(F.sum(F.when(hit, count).otherwise(0)).alias(f"{family}_events"))
        if family in with_damage:
            columns.append(
                F.sum(F.when(hit, damage).otherwise(0.0)).alias(f"{family}_total_damage")
            )
    return events.groupBy(names.entity).agg(
        F.sum(count).alias("all_events"),
        F.sum(names.event_severe).alias("all_severe"),
        F.sum(names.event_minor).alias("all_minor"),
        mean(F.col(names.event_avg_damage)).alias("mean_damage"),
        F.sum(damage).alias("all_total_damage"),
        *columns,
    )


def guarded_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``name = numerator / denominator``, NULL unless the denominator is positive."""
    return df.withColumns(
        {name: guarded_ratio(F.col(n), F.col(d)) for name, (n, d) in ratios.items()}
    )


def feature_table(
    base: DataFrame, pivot: DataFrame, ratios: Mapping[str, tuple[str, str]],
    names: Names = Names(),
) -> DataFrame:
    """Base features with the event pivot, zero where an entity had no events."""
    added = [c for c in pivot.columns if c != names.entity]
    joined = base.join(pivot, names.entity, "left").withColumns(
        {c: zero_if_null(F.col(c)) for c in added}
    )
    return guarded_ratios(joined, ratios)


def entity_features(
    features: DataFrame, resolved: DataFrame, names: Names = Names()
) -> DataFrame:
    """Feature rows of resolved entities, without money totals."""
    kept = [c for c in features.columns if not c.endswith("total_damage")]
    return features.join(resolved.select(names.entity), names.entity, "left_semi").select(*kept)


# -- single transforms --------------------------------------------------------------------


def log_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<c>_log`` = log1p of the value clipped at zero; absent columns are skipped."""
    return df.withColumns(
        {
            f"{c}_log": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))
            for c in columns
            if c in df.columns
        }
    ) if columns else df


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of the non-NULL values; one row reaches the driver."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return {}
    tall = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                    for c in present
                ]
            )
        )
    )
    rows = exact_quantiles(tall, ["feature"], "value", [0.5], ["median"]).collect()
    found = {r["feature"]: r["median"] for r in rows}
    return {c: found.get(c) for c in present}


def median_impute(
    df: DataFrame, columns: Sequence[str], medians: Mapping[str, float | None] | None = None
) -> DataFrame:
    """Fill NULLs of the listed columns with medians, by default those of ``df`` itself."""
    if medians is None:
        medians = column_medians(df, columns)
    fills = {c: float(medians[c]) for c in columns if medians.get(c) is not None}
    if not fills:
        return df
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()}
    )


def lag_features(
    df: DataFrame, columns: Sequence[str], lags: Sequence[int] = (1, 2, 3),
    key: str = "entity_id", order: str = "year",
) -> DataFrame:
    """``<c>_lagN``: the value N rows earlier of the same entity.

    The mart holds one row per entity and year, so a window partition is a handful of rows.
    """
    if key not in df.columns or order not in df.columns:
        return df
    window = Window.partitionBy(key).orderBy(order)
    added = {
        f"{c}_lag{n}": F.lag(c, n).over(window) for c in columns if c in df.columns for n in lags
    }
    return df.withColumns(added) if added else df


def category_levels(df: DataFrame, column: str, max_levels: int | None = None) -> list[str]:
    """Sorted distinct values of a low-cardinality column; each becomes a column of a matrix.

    With ``max_levels`` more values than that raise an error.
    """
    values = df.select(F.col(column).cast("string")).dropna().distinct()
    rows = (values if max_levels is None else values.limit(max_levels + 1)).collect()
    if max_levels is not None and len(rows) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    return sorted(r[0] for r in rows)


def one_hot(
    df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None,
    drop_first: bool = True,
) -> DataFrame:
    """``<c>_<level>`` as 0.0/1.0 for each fitted level; the first level is the reference."""
    present = [c for c in columns if c in df.columns]
    if levels is None:
        levels = {c: category_levels(df, c) for c in present}
    added = {
        f"{c}_{v}": F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0)
        for c in present
        for v in list(levels[c])[1 if drop_first else 0:]
    }
    return (df.withColumns(added) if added else df).drop(*present)


def drop_incomplete(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows without any NULL; or only those with a target value."""
    return df.na.drop(subset=[target]) if target else df.na.drop("any")


def align_features(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Exactly the model's columns in order, after ``keep``; missing ones and NULLs become 0."""
    return df.select(
        *keep,
        *[
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0))
            .alias(c)
            for c in features
        ]
    )


def align_train_test(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames reduced to their common columns, in the first frame's order."""
    common = [c for c in train.columns if c in test.columns]
    return train.select(*common), test.select(*common)


# -- fitted pipeline ----------------------------------------------------------------------


@dataclass(frozen=True)
class FittedFeatures:
    """Medians and levels learned on the training rows, applied unchanged everywhere."""

    spec: FeatureSpec
    medians: dict[str, float | None]
    levels: dict[str, list[str]]

    def transform(
        self, df: DataFrame, keep_incomplete: bool = False, carry: Sequence[str] = ()
    ) -> DataFrame:
        """Impute, log, lag, one-hot, drop incomplete rows, keep whitelisted columns.

        Imputation comes first so that logs see filled values.  ``carry`` names columns that
        are no features but stay beside them.
        """
        spec = self.spec
        out = median_impute(df, spec.numeric, self.medians)
        out = log_features(out, spec.log)
        out = lag_features(out, spec.lag, spec.lags, spec.key, spec.order)
        out = one_hot(out, spec.categorical, self.levels)
        if not keep_incomplete:
            out = drop_incomplete(out)
        out = out.drop(*spec.drop)
        made = {*self.made_columns(), *carry}
        return out.select([c for c in out.columns if c in made])

    def made_columns(self) -> list[str]:
        """Exactly the columns that ``transform`` may put into a matrix."""
        spec = self.spec
        levels = [f"{c}_{v}" for c in spec.categorical for v in self.levels.get(c, [])]
        return [*spec.numeric, *spec.passthrough, *[f"{c}_log" for c in spec.log], *levels]

    def feature_names(self, columns: Sequence[str]) -> list[str]:
        return [c for c in columns if c not in self.spec.passthrough]

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON document: the feature schema and the fitted values."""
        body = json.dumps(
            {"spec": asdict(self.spec), "medians": self.medians, "levels": self.levels}
        )
        frame = spark.range(1).select(F.lit(body).alias("value"))
        frame.coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedFeatures:
        body = json.loads(spark.read.text(path).first()[0])
        spec = {k: tuple(v) if isinstance(v, list) else v for k, v in body["spec"].items()}
        return FittedFeatures(FeatureSpec(**spec), body["medians"], body["levels"])


@dataclass(frozen=True)
class FeaturePipeline:
    spec: FeatureSpec

    def fit(self, df: DataFrame) -> FittedFeatures:
        levels = {
            c: category_levels(df, c) for c in self.spec.categorical if c in df.columns
        }
        return FittedFeatures(self.spec, column_medians(df, self.spec.numeric), levels)


LABELS = ("LOW", "MEDIUM", "HIGH")


def label_encode(
    df: DataFrame, target: str = "risk_bucket", passthrough: Sequence[str] = (),
    labels: Sequence[str] = LABELS,
) -> tuple[DataFrame, list[str]]:
    """``label`` 0/1/2 beside the numeric feature columns; an unknown label fails the job."""
    skip = {target, *passthrough}
    numeric = [
        f.name
        for f in df.schema
        if f.name not in skip and isinstance(f.dataType, T.NumericType | T.BooleanType)
    ]
    unknown = F.raise_error(F.concat(F.lit("Unmapped label: "), F.col(target).cast("string")))
    code = None
    for i, name in enumerate(labels):
        hit = F.col(target) == name
        code = F.when(hit, F.lit(i)) if code is None else code.when(hit, F.lit(i))
    return df.withColumn("label", code.otherwise(unknown.cast("int"))), numeric
