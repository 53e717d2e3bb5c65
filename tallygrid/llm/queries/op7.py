"""The ten nearest embeddings of every hundredth one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..graph_index import nearest, usable


def op7_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10)


QUERIES = {"op7_graph_search": op7_graph_search}
