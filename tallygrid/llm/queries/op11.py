"""The main text of all pages, with weights from those that mark their article."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..html_content import extract, fit


def op11_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))


QUERIES = {"op11_html_content": op11_html_content}
