"""All documents linked by the similarity of their four-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..ngram_join import jaccard_components


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, n=4, num=85, den=100)


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
