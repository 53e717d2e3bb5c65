"""Exact cosine top-k over a vector table, context and citation assembly."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numeric import rounded

# The block scorer travels with its tasks; executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Queries that travel to the vectors at once, and the rows that are scored at once.
QUERY_BLOCK = 16_384
QUERY_SLICE = 1_024
SLICE = 8_192

TOP_K = 5
MIN_SCORE = 0.4
LOW_CONFIDENCE = 0.5
# Scores this close count as equal and are ordered by id.
TIE_PLACES = 12


def _unit_rows(column: pa.ChunkedArray | pa.Array, ids: list, length: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision; all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != length).any():
        at = int(np.flatnonzero(sizes != length)[0])
        raise ValueError(f"vector {ids[at]!r} has {sizes[at]} values, not {length}")
    flat = column.flatten()
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    if flat.null_count or not np.isfinite(rows).all():
        at = int(np.flatnonzero(~np.isfinite(rows).all(axis=1))[0])
        raise ValueError(f"vector {ids[at]!r} holds NULL or a value that is not finite")
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(norms > 0, norms, 1.0)[:, None]


class _Hits:
    """The k best vectors so far of every query: its number, the vector's id, the score."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.vector, self.score = np.array([], np.int64), [], np.array([])

    def add(self, query: np.ndarray, vector: list, score: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        vector = self.vector + vector
        # Ids of any type are ordered by their place among the ids at hand.
        place = {v: i for i, v in enumerate(sorted(set(vector)))}
        rank = np.array([place[v] for v in vector], np.int64)
        order = np.lexsort((rank, -score, query))
        query = query[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.score = query[kept], score[order][kept]
        self.vector = [vector[i] for i in order[kept]]


def _score(hits: _Hits, first: int, query_ids: list, query_rows: np.ndarray, ids: list,
           unit: np.ndarray, exclude_self: bool) -> None:
    """Add a slice of queries against a slice of vectors; ties at the edge go to the smaller id."""
    scores = np.round(query_rows @ unit.T, TIE_PLACES)
    if exclude_self:
        place = {v: j for j, v in enumerate(ids)}
        for i, q in enumerate(query_ids):
            if q in place:
                scores[i, place[q]] = -np.inf
    n, k = scores.shape[1], hits.k
    floor = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -2.0)
    i, j = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
    hits.add(i + first, [ids[x] for x in j], scores[i, j])


def _valid(df: DataFrame, id_col: str, vector: str, as_id: str, as_vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(
        F.col(id_col).alias(as_id), F.col(vector).cast("array<double>").alias(as_vector)
    )


def cosine_topk(
    queries: DataFrame, vectors: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE,
    query_id: str = "query_id", query_vector: str = "embedding", vector_id: str = "vec_id",
    vector: str = "embedding", exclude_self: bool = False, max_queries: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the k nearest vectors, then the score floor.

    Ids may be of any type that has an order.  All vectors must be of one length.  Blocks of
    at most about ``max_queries`` queries travel to the tasks, and every vector is scored where
    it lies; more queries take more passes over the vectors, which are never shuffled.  A
    task returns only its k best per query, and the final choice merges those.
    """
    if k < 1:
        k = TOP_K
    q = _valid(queries, query_id, query_vector, "_qid", "_qvec")
    v = _valid(vectors, vector_id, vector, "_vid", "_vec")
    blocks = max(1, -(-q.count() // max_queries))
    partial = None
    for block in range(blocks):
        own = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("_qid"), F.lit(blocks)) == block)
        scored = _score_in_place(own, v, k, exclude_self)
        partial = scored if partial is None else partial.unionByName(scored)
    order = Window.partitionBy("_qid").orderBy(F.desc("_score"), F.asc("_vid"))
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter((F.col("rank") <= k) & (F.col("_score") >= min_score))
        .select(
            F.col("_qid").alias(query_id),
            F.col("_vid").alias(vector_id),
            rounded(F.col("_score"), 4).alias("score"),
            "rank",
        )
    )


def _score_in_place(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    schema = T.StructType([
        queries.schema["_qid"], vectors.schema["_vid"], T.StructField("_score", T.DoubleType())
    ])
    table = queries.toArrow()
    if table.num_rows == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    query_ids = table.column("_qid").to_pylist()
    length = len(table.column("_qvec")[0])
    matrix = _unit_rows(table.column("_qvec"), query_ids, length)
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rows = shared.value
        hits, types = _Hits(k), None
        for batch in batches:
            ids = batch.column("_vid").to_pylist()
            types = batch.column("_vid").type
            unit = _unit_rows(batch.column("_vec"), ids, length) if ids else None
            for at in range(0, len(ids), SLICE):
                for first in range(0, len(asked), QUERY_SLICE):
                    part = slice(first, first + QUERY_SLICE)
                    _score(hits, first, asked[part], rows[part], ids[at : at + SLICE],
                           unit[at : at + SLICE], exclude_self)
        if types is not None:
            found = [asked[i] for i in hits.query]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, table.schema.field("_qid").type), pa.array(hits.vector, types),
                 pa.array(hits.score)], names=["_qid", "_vid", "_score"])

    return vectors.mapInArrow(score, schema)


def retrieve_chunks(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE,
    query_id: str = "query_id", query_vector: str = "embedding", chunk_id: str = "chunk_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k nearest chunks of every query, with all their columns but the vector.

    Only the hits' ids meet the chunk table; AQE broadcasts them where they are few.
    """
    hits = cosine_topk(queries, chunks, k, min_score, query_id, query_vector, chunk_id, vector)
    return hits.join(chunks.drop(vector), chunk_id)


def retrieval_confidence(
    hits: DataFrame, floor: float = LOW_CONFIDENCE, query_id: str = "query_id"
) -> DataFrame:
    """Best score per query and whether it is low."""
    return hits.groupBy(query_id).agg(F.max("score").alias("max_score")).withColumn(
        "low_confidence", F.col("max_score") < floor
    )


def build_context(
    hits: DataFrame, query_id: str = "query_id", source: str = "source", tag: str = "tag",
    text: str = "text",
) -> DataFrame:
    """Context block per query: numbered headers and texts in rank order.

    A query has at most k hits, so a block is k texts long.
    """
    named = F.when(
        F.col(tag).isNotNull() & ~F.col(tag).isin("", "general"),
        F.concat(F.lit(" | Hazard: "), F.col(tag)),
    ).otherwise(F.lit(""))
    number = F.row_number().over(Window.partitionBy(query_id).orderBy("rank"))
    header = F.concat(
        F.lit("[Source "), F.col("_n").cast("string"), F.lit(": "),
        F.coalesce(F.col(source).cast("string"), F.lit("Unknown source")), named,
        F.lit(" | similarity="), F.format_number("score", 2), F.lit("]\n"),
    )
    part = F.concat(header, F.coalesce(F.col(text), F.lit("")))
    return (
        hits.withColumn("_n", number)
        .select(query_id, F.struct("_n", part.alias("_part")).alias("_s"))
        .groupBy(query_id)
        .agg(F.array_sort(F.collect_list("_s")).alias("_parts"))
        .select(
            query_id,
            F.size("_parts").alias("sources"),
            F.array_join(F.transform("_parts", lambda s: s["_part"]), "\n\n---\n\n").alias(
                "context"
            ),
        )
    )


def citations(hits: DataFrame, query_id: str = "query_id", source: str = "source") -> DataFrame:
    """First hit of each source per query, in rank order."""
    first = Window.partitionBy(query_id, source).orderBy("rank")
    return (
        hits.filter(F.col(source).isNotNull() & (F.col(source).cast("string") != ""))
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .drop("_n")
    )


def rows_to_text(
    df: DataFrame, group: str, order: Sequence[str], columns: Sequence[str], max_rows: int = 25
) -> DataFrame:
    """A result table per group as text: header, rule, the first rows, what was left out."""
    header = " | ".join(columns)
    line = F.concat_ws(
        " | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    shown = (
        df.withColumn("_n", rank)
        .filter(F.col("_n") <= max_rows)
        .select(group, F.struct("_n", line.alias("_line")).alias("_s"))
        .groupBy(group)
        .agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_line"]).alias("_l"))
    )
    sizes = df.groupBy(group).agg(F.count("*").alias("rows"))
    left = F.col("rows") - max_rows
    tail = F.when(left > 0, F.concat(F.lit("\n... ("), left, F.lit(" more rows truncated)")))
    body = F.concat(
        F.lit(header + "\n" + "-" * len(header) + "\n"),
        F.array_join("_l", "\n"),
        F.coalesce(tail, F.lit("")),
    )
    return sizes.join(shown, group).select(group, "rows", body.alias("table_text"))
