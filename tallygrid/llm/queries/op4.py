"""All documents packed into windows of at most 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..packing import pack

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame) -> DataFrame:
    packed = pack(docs, TOKENIZER, RANKS, public_tokenizers.PATTERN)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "tier", "step_group",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_packing": op4_packing}
