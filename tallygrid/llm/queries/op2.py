"""All documents scored by a hierarchical Pitman-Yor model of six sevenths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..pitman_yor import score


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_pitman_yor": op2_pitman_yor}
