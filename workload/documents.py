"""Documents, chunks and retrieval over the supplied texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid import vocabulary as words
from tallygrid.functions.sizing import spread
from tallygrid.operators import documents, retrieval
from tallygrid.sources.keyed import KeyedTable
from tallygrid.sources.shared import shared_path
from workload.gold import ENTITY, MART, entity, mart, table

WIDTH, STRIDE = 2048, 1792

# The invented prose holds none of the hazard terms; these fragments do occur in it.
FRAGMENTS = ("theandof", "ighted", "keiten", "ationin", "eaux", "tion", "er")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _normalize(spark, sf_dir):
    rows = documents.normalize_text(spread(docs(spark, sf_dir)))
    return rows.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars"))


def _nonempty(spark, sf_dir):
    """Documents whose text without its lower-case letters is not blank."""
    bare = docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[^0-9\\s]", ""))
    return documents.nonempty_docs(bare).select("doc_id")


def _flat(chunks):
    return chunks.select(
        "id",
        F.col("metadata.source").alias("source"),
        F.col("metadata.section").alias("section"),
        F.col("metadata.chunk_index").alias("chunk_index"),
        F.col("metadata.total_chunks").alias("total_chunks"),
        F.md5("text").alias("digest"),
    )


def _chunk(spark, sf_dir):
    return _flat(documents.chunk_documents(docs(spark, sf_dir)))


def _chunk_wide(spark, sf_dir):
    """Overlap above half the size: a window spans several strides."""
    return _flat(documents.chunk_documents(docs(spark, sf_dir), size=256, overlap=192))


def _tag(spark, sf_dir):
    chunks = documents.chunk_documents(docs(spark, sf_dir))
    hazard = documents.tag_chunks(chunks, name="hazard_tag")
    return documents.tag_chunks(hazard, FRAGMENTS).select("id", "hazard_tag", "tag")


def _counts(spark, sf_dir):
    return documents.chunk_counts(documents.chunk_documents(docs(spark, sf_dir)))


def _versions(spark, sf_dir):
    """Every third document gets a new text; new keys come from the benchmark items."""
    old = documents.chunk_documents(docs(spark, sf_dir)).select("id", "text")
    changed = docs(spark, sf_dir).filter(F.col("doc_id") % 3 == 0).withColumn(
        "text", F.concat(F.lit("revised "), "text")
    )
    added = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 1_000_000_000).alias("doc_id"), "text"
    )
    return old, documents.chunk_documents(changed.unionByName(added)).select("id", "text")


def _upsert(spark, sf_dir):
    merged = documents.upsert_chunks(*_versions(spark, sf_dir))
    return merged.select("id", F.md5("text").alias("digest"))


def _keyed(spark, sf_dir):
    """The same writes as two versions of a keyed table in the shared folder."""
    path = shared_path(spark, "keyed")
    old, new = _versions(spark, sf_dir)
    KeyedTable(spark, path, "id").upsert(old)
    # the stored number of buckets counts, not this one
    table_ = KeyedTable(spark, path, "id", buckets=7)
    table_.upsert(new)
    return table_.read().select("id", F.md5("text").alias("digest"))


def centroids(spark, sf_dir):
    """One query vector per label, the mean of its vectors, summed position by position."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("query_id"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"),
    )
    means = cells.groupBy("query_id", "i").agg(F.avg("x").alias("x"))
    parts = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("query_id").agg(
        F.transform(parts, lambda c: c["x"]).alias("embedding")
    )


MIN_SCORE = 0.1


def _hits(spark, sf_dir, k=5):
    return retrieval.cosine_topk(
        centroids(spark, sf_dir), table(spark, sf_dir, "embeddings"), k, MIN_SCORE
    )


def _topk(spark, sf_dir):
    return _hits(spark, sf_dir)


def _confidence(spark, sf_dir):
    return retrieval.retrieval_confidence(_hits(spark, sf_dir))


def _sourced(spark, sf_dir):
    """Hits with the text of the document of the same number."""
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), "text", "source", F.col("lang").alias("tag")
    )
    return _hits(spark, sf_dir, 8).join(texts, "vec_id")


def _context(spark, sf_dir):
    rows = retrieval.build_context(
        _sourced(spark, sf_dir).withColumn(
            "tag", F.when(F.col("tag") == "en", "general").otherwise(F.col("tag"))
        )
    )
    return rows.select("query_id", "sources", F.md5("context").alias("digest"))


def _citations(spark, sf_dir):
    hits = _sourced(spark, sf_dir).withColumn("source", F.col("tag"))
    return retrieval.citations(hits).select("query_id", "source", "vec_id", "score")


def _rows_text(spark, sf_dir):
    """The yearly event counts of a group's entities as one small text table per group."""
    rows = mart(spark, sf_dir).join(entity(spark, sf_dir), "entity_id").select(
        "group_name", "entity_id", "year", "event_count"
    )
    return retrieval.rows_to_text(
        rows, "group_name", ["entity_id", "year"], ["entity_id", "year", "event_count"]
    )


QUERIES = {
    "normalize_text": _normalize,
    "nonempty_docs": _nonempty,
    "chunk_documents": _chunk,
    "chunk_documents_wide_overlap": _chunk_wide,
    "tag_chunks": _tag,
    "chunk_counts": _counts,
    "upsert_chunks": _upsert,
    "keyed_upsert": _keyed,
    "cosine_topk": _topk,
    "retrieval_confidence": _confidence,
    "build_context": _context,
    "citations": _citations,
    "rows_to_text": _rows_text,
}

_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _chunk_sql(source: str, width: int = WIDTH, stride: int = STRIDE) -> str:
    return f"""clean_{source} AS (SELECT doc_id, {_CLEAN.format("text")} AS t FROM {source}),
starts_{source} AS (SELECT doc_id, t, unnest(generate_series(0, length(t) - 1, {stride})) AS s
  FROM clean_{source} WHERE t <> ''),
chunks_{source} AS (SELECT md5(doc_id || '::' || (s // {stride})) AS id,
  CAST(doc_id AS VARCHAR) AS source, 'chunk_' || (s // {stride}) AS section,
  CAST(s // {stride} AS INTEGER) AS chunk_index,
  CAST(ceil(length(t) / {stride}.0) AS INTEGER) AS total_chunks,
  substring(t, CAST(s AS BIGINT) + 1, {width}) AS text FROM starts_{source})"""


def _flat_sql(width: int = WIDTH, stride: int = STRIDE) -> str:
    return f"""WITH {_chunk_sql("documents", width, stride)}
SELECT id, source, section, chunk_index, total_chunks, md5(text) AS digest
FROM chunks_documents"""


def _first(terms) -> str:
    cases = " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t}'" for t in terms)
    return f"CASE {cases} ELSE 'general' END"


def _hits_sql(k: int) -> str:
    return f"""cells AS (SELECT CAST(label AS BIGINT) AS query_id, CAST(unnest(embedding) AS DOUBLE) AS x,
  generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT query_id, i, AVG(x) AS x FROM cells GROUP BY query_id, i),
queries AS (SELECT query_id, list(x ORDER BY i) AS q FROM means GROUP BY query_id),
scored AS (SELECT query_id, vec_id,
  ROUND(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 12) AS s
  FROM queries, embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank
  FROM scored),
hits AS (SELECT query_id, vec_id, ROUND(s, 4) AS score, CAST(rank AS INTEGER) AS rank
  FROM ranked WHERE rank <= {k} AND s >= {MIN_SCORE})"""


ORACLES = {
    "normalize_text": f"""SELECT doc_id, md5({_CLEAN.format("text")}) AS digest,
  CAST(length({_CLEAN.format("text")}) AS INTEGER) AS chars FROM documents""",
    "nonempty_docs": "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]')",
    "chunk_documents": _flat_sql(),
    "chunk_documents_wide_overlap": _flat_sql(1024, 256),
    "tag_chunks": f"""WITH {_chunk_sql("documents")}
SELECT id, {_first(words.CHUNK_TAGS)} AS hazard_tag, {_first(FRAGMENTS)} AS tag
FROM chunks_documents""",
    "chunk_counts": f"""WITH {_chunk_sql("documents")}
SELECT source, COUNT(*) AS chunks, CAST(SUM(length(text)) AS BIGINT) AS chars
FROM chunks_documents GROUP BY source
UNION ALL SELECT NULL, COUNT(*), CAST(SUM(length(text)) AS BIGINT) FROM chunks_documents""",
    "upsert_chunks": f"""WITH changed AS (
  SELECT doc_id, 'revised ' || text AS text FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT item_id + 1000000000, text FROM benchmark),
{_chunk_sql("documents")}, {_chunk_sql("changed")}
SELECT id, md5(text) AS digest FROM chunks_documents
WHERE id NOT IN (SELECT id FROM chunks_changed)
UNION ALL SELECT id, md5(text) FROM chunks_changed""",
    "cosine_topk": f"WITH {_hits_sql(5)} SELECT query_id, vec_id, score, rank FROM hits",
    "retrieval_confidence": f"""WITH {_hits_sql(5)}
SELECT query_id, MAX(score) AS max_score, MAX(score) < 0.5 AS low_confidence
FROM hits GROUP BY query_id""",
    "build_context": f"""WITH {_hits_sql(8)},
numbered AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n,
  score, source, CASE WHEN lang = 'en' THEN 'general' ELSE lang END AS tag, text
  FROM hits JOIN documents ON vec_id = doc_id)
SELECT query_id, CAST(COUNT(*) AS INTEGER) AS sources, md5(string_agg(
  '[Source ' || n || ': ' || source
  || CASE WHEN tag IN ('', 'general') THEN '' ELSE ' | Hazard: ' || tag END
  || ' | similarity=' || printf('%.2f', score) || ']' || chr(10) || text,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS digest
FROM numbered GROUP BY query_id""",
    "citations": f"""WITH {_hits_sql(8)},
firsts AS (SELECT query_id, lang AS source, vec_id, score,
  row_number() OVER (PARTITION BY query_id, lang ORDER BY rank) AS n
  FROM hits JOIN documents ON vec_id = doc_id)
SELECT query_id, source, vec_id, score FROM firsts WHERE n = 1""",
    "rows_to_text": f"""WITH {ENTITY}, {MART},
numbered AS (SELECT group_name, m.entity_id, year, event_count,
  row_number() OVER (PARTITION BY group_name ORDER BY m.entity_id, year) AS n,
  COUNT(*) OVER (PARTITION BY group_name) AS rows
  FROM g_mart m JOIN g_entity e ON m.entity_id = e.entity_id)
SELECT group_name, rows, 'entity_id | year | event_count' || chr(10) || repeat('-', 30)
  || chr(10) || string_agg(entity_id || ' | ' || year || ' | ' || event_count, chr(10)
    ORDER BY n)
  || CASE WHEN rows > 25 THEN chr(10) || '... (' || (rows - 25) || ' more rows truncated)'
    ELSE '' END AS table_text
FROM numbered WHERE n <= 25 GROUP BY group_name, rows""",
}
ORACLES["keyed_upsert"] = ORACLES["upsert_chunks"]
