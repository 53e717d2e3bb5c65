"""Document chunking, tagging and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sizing import spread
from ..functions.text import NOT_SPACE, first_contained, squeeze_whitespace
from ..vocabulary import CHUNK_TAGS

CHARS_PER_TOKEN = 4


def nonempty_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with something besides white space."""
    return docs.filter(F.col(text).rlike(NOT_SPACE))


def normalize_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """White space squeezed to single blanks."""
    return docs.withColumn(text, squeeze_whitespace(F.col(text)))


def chunk_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 512, overlap: int = 64
) -> DataFrame:
    """Overlapping chunks of whole documents with a deterministic id.

    ``size`` and ``overlap`` are in tokens of about four characters.  The last chunk may
    be short and may lie inside the one before it.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    width = size * CHARS_PER_TOKEN
    stride = width - overlap * CHARS_PER_TOKEN
    source = F.col(key).cast("string")
    # The text is cut once into blocks of one stride; a chunk joins the blocks it spans,
    # which is linear in the text where a substring per chunk would rescan it.  Blocks are
    # a column of their own so that they are computed once per document.
    blocks = F.regexp_extract_all(
        squeeze_whitespace(F.col(text)), F.lit(rf"(?s).{{1,{stride}}}"), F.lit(0)
    )
    spanned = -(-width // stride)
    cut = spread(docs.select(key, text)).select(key, blocks.alias("_blocks"))
    windows = F.transform(
        "_blocks",
        lambda _, i: F.substring(
            F.array_join(F.slice("_blocks", i + 1, F.lit(spanned)), ""), 1, width
        ),
    )
    # No blocks, no chunks: blank documents need no filter.
    chunks = cut.select(
        key,
        F.size("_blocks").alias("total_chunks"),
        F.posexplode(windows).alias("chunk_index", "text"),
    )
    return chunks.select(
        F.md5(F.concat(source, F.lit("::"), F.col("chunk_index").cast("string"))).alias("id"),
        "text",
        F.struct(
            source.alias("source"),
            F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string")).alias("section"),
            "chunk_index",
            "total_chunks",
        ).alias("metadata"),
    )


def tag_chunks(
    chunks: DataFrame, vocabulary: Sequence[str] = CHUNK_TAGS, default: str = "general",
    text: str = "text", name: str = "tag",
) -> DataFrame:
    """First vocabulary term, in list order, that a chunk contains."""
    terms = {term: term for term in vocabulary}
    lowered = chunks.withColumn("_lower", F.lower(text))
    return lowered.withColumn(name, first_contained(F.col("_lower"), terms, default)).drop("_lower")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and characters per source, and over all sources (source NULL)."""
    per_source = chunks.groupBy(F.col("metadata.source").alias("source")).agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars")
    )
    overall = per_source.agg(
        F.lit(None).cast("string").alias("source"),
        F.sum("chunks").alias("chunks"),
        F.sum("chars").alias("chars"),
    )
    return per_source.unionByName(overall)


def upsert_chunks(
    old: DataFrame, new: DataFrame, key: str = "id", version: Column | None = None
) -> DataFrame:
    """The table after writing ``new`` over ``old`` by key.

    With several new rows per key, the one with the largest ``version`` counts.
    """
    if version is not None:
        latest = Window.partitionBy(key).orderBy(version.desc())
        new = (
            new.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")
        )
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new)
