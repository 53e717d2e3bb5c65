"""Byte-level BPE over all documents: ids, and the bytes that they decode to."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..byte_bpe import decode, encode

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "ids")
    both = decode(encoded, RANKS, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
