"""Writers of datasets, partitioned predictions and small artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_predictions(
    predictions: DataFrame, path: str, run_date: Column | str, model: str,
) -> None:
    """Predictions partitioned by run date; a rerun replaces its own date only."""
    date = F.lit(run_date) if isinstance(run_date, str) else run_date
    (
        predictions.withColumn("model", F.lit(model))
        .withColumn("run_date", date)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )


def run_date_of(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def write_json(df: DataFrame, path: str) -> None:
    """A report-sized frame as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report-sized frame as CSV with a header in one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Has a dataset been written to this path?"""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
