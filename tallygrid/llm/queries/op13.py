"""All conversations, damaged by the hash of their turns, and their cheapest repair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..conversation_repair import COUNTS, damaged, repair


def digested(repaired: DataFrame) -> DataFrame:
    """A row per conversation; the repaired turns as the SHA-256 of their lines.

    Rows of a conversation follow one another, so the digest is fed turn by turn.
    """
    fields = ["conv_id", *COUNTS, "audit"]
    schema = T.StructType([repaired.schema[f] for f in fields]).add(
        "repaired_sha256", T.StringType()).add("n_turns", T.LongType())
    source = repaired.select(
        *fields, "position", F.concat_ws(":", "role", "text").alias("line"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, state, turns = None, None, 0
        for batch in batches:
            done = []
            for *values, position, line in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if position is None:
                    if report:
                        done.append((*report, state.hexdigest(), turns))
                    report, state, turns = values, hashlib.sha256(), 0
                else:
                    state.update(("\n" if turns else "").encode() + line.encode())
                    turns += 1
            yield _batch(done)
        yield _batch([(*report, state.hexdigest(), turns)] if report else [])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(schema)]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

    return source.mapInArrow(work, schema)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digested(repair(damaged(rows), rows.select("conv_id")))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
