from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import documents, retrieval

from .conftest import dicts

# Lengths around stride and width, blanks, odd white space, a character outside the BMP.
TEXTS = {
    "empty": "",
    "blank": " \t\n\x1c ",
    "stride": "a" * 1792,
    "stride1": "b" * 1793,
    "width": "c" * 2048,
    "width1": "d" * 2049,
    "spaces": "one two\x1cthree \n\n four　",
    "emoji": "\U0001f600x" * 2000,
    "words": " ".join(f"w{i}" for i in range(3000)),
}


def brute(text: str, size: int, overlap: int) -> list[str]:
    text = re.sub(r"\s+", " ", text).strip()
    step = (size - overlap) * 4
    return [text[s : s + size * 4] for s in range(0, len(text), step)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "name string, text string")


@pytest.mark.parametrize(("size", "overlap"), [(512, 64), (512, 0), (100, 90), (1, 0)])
def test_chunks_equal_brute_force(docs, size, overlap):
    chunks = documents.chunk_documents(docs, "name", "text", size, overlap)
    found: dict[str, dict[int, str]] = {}
    for r in chunks.collect():
        meta = r["metadata"]
        found.setdefault(meta["source"], {})[meta["chunk_index"]] = r["text"]
        key = f"{meta['source']}::{meta['chunk_index']}"
        assert r["id"] == hashlib.md5(key.encode()).hexdigest()
        assert meta["section"] == f"chunk_{meta['chunk_index']}"
        assert meta["total_chunks"] == len(brute(TEXTS[meta["source"]], size, overlap))
    for name, text in TEXTS.items():
        expected = brute(text, size, overlap)
        assert [found.get(name, {})[i] for i in range(len(expected))] == expected, name
    assert "empty" not in found and "blank" not in found


def test_overlap_must_be_smaller(docs):
    with pytest.raises(ValueError, match="overlap"):
        documents.chunk_documents(docs, "name", "text", 64, 64)


def test_text_normalisation(docs):
    rows = {r["name"]: r["text"] for r in documents.normalize_text(docs).collect()}
    for name, text in TEXTS.items():
        assert rows[name] == re.sub(r"\s+", " ", text).strip()
    kept = {r["name"] for r in documents.nonempty_docs(docs).collect()}
    assert kept == set(TEXTS) - {"empty", "blank"}


def test_tags_follow_list_order(spark):
    df = spark.createDataFrame(
        [(1, "A tornado after the FLOOD"), (2, "winter storm, thunderstorm"), (3, "calm")],
        "i int, text string",
    )
    rows = {r["i"]: r["tag"] for r in documents.tag_chunks(df).collect()}
    assert rows == {1: "flood", 2: "winter storm", 3: "general"}


def test_counts_and_upsert(spark, docs):
    chunks = documents.chunk_documents(docs, "name", "text")
    counts = {r["source"]: r["chunks"] for r in documents.chunk_counts(chunks).collect()}
    assert counts["width"] == 2 and counts["stride"] == 1
    assert counts[None] == sum(v for k, v in counts.items() if k)
    again = documents.upsert_chunks(chunks, chunks)
    assert again.count() == chunks.count()
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, text string")
    new = spark.createDataFrame(
        [("b", "3", 1), ("b", "4", 2), ("c", "5", 1)], "id string, text string, v int"
    )
    merged = documents.upsert_chunks(
        old.withColumn("v", F.lit(0)), new, version=F.col("v")
    )
    assert {(r["id"], r["text"]) for r in merged.collect()} == {
        ("a", "1"), ("b", "4"), ("c", "5")
    }


# -- retrieval ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    values = rng.normal(size=(400, 8))
    values[100:140] = values[3]  # many exact copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    rows += [(900, None), (901, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    return df.persist(), values.astype(np.float32).astype(np.float64)


def expected_topk(values, queries, k, floor, exclude):
    unit = values / np.linalg.norm(values, axis=1)[:, None]
    out = {}
    for q in queries:
        scores = np.round(unit @ unit[q], 12)
        order = sorted(
            (i for i in range(len(values)) if not (exclude and i == q)),
            key=lambda i: (-scores[i], i),
        )[:k]
        out[q] = [(i, round(float(scores[i]), 4)) for i in order if scores[i] >= floor]
    return out


@pytest.mark.parametrize("max_queries", [1_000, 7])
@pytest.mark.parametrize("exclude", [True, False])
def test_topk_equals_brute_force(vectors, max_queries, exclude, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_SLICE", 9)
    monkeypatch.setattr(retrieval, "SLICE", 64)
    df, values = vectors
    queries = df.filter("vec_id < 25").withColumnRenamed("vec_id", "query_id")
    hits = retrieval.cosine_topk(
        queries, df, k=6, min_score=0.5, exclude_self=exclude, max_queries=max_queries
    )
    got: dict[int, list] = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = expected_topk(values, range(25), 6, 0.5, exclude)
    assert got == {q: v for q, v in expected.items() if v}


def test_chunks_are_found_by_their_string_ids(vectors):
    df, values = vectors
    chunks = df.select(F.md5(F.col("vec_id").cast("string")).alias("chunk_id"), "embedding",
                       F.concat(F.lit("text "), "vec_id").alias("text"))
    queries = df.filter("vec_id < 3").select(
        F.concat(F.lit("q"), "vec_id").alias("query_id"), "embedding")
    hits = retrieval.retrieve_chunks(queries, chunks, k=1).collect()
    assert {(r["query_id"], r["text"]) for r in hits} == {(f"q{i}", f"text {i}") for i in range(3)}
    assert "embedding" not in hits[0].asDict()


@pytest.mark.parametrize("bad", [[1.0] * 5, [1.0] * 7 + [None], [1.0] * 7 + [float("inf")]])
def test_a_bad_vector_is_named(spark, vectors, bad):
    df, _ = vectors
    queries = df.filter("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    other = spark.createDataFrame([(77, bad)], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="vector 77"):
        retrieval.cosine_topk(queries, other).collect()


def test_floor_applies_after_topk_and_k_zero_means_default(vectors):
    df, values = vectors
    queries = df.filter("vec_id = 3").withColumnRenamed("vec_id", "query_id")
    assert retrieval.cosine_topk(queries, df, k=0, min_score=-1.0).count() == 5
    assert retrieval.cosine_topk(queries, df, k=3, min_score=0.999).count() == 3
    none = df.filter("vec_id < 0").withColumnRenamed("vec_id", "query_id")
    assert retrieval.cosine_topk(none, df).count() == 0


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(
        [
            ("q1", 1, 0.92, "a.txt", "Flood", "first"),
            ("q1", 2, 0.78, "b.txt", "general", "second"),
            ("q1", 3, 0.78, "a.txt", "Flood", "third"),
            ("q2", 1, 0.345, None, None, "weak"),
        ],
        "query_id string, rank int, score double, source string, tag string, text string",
    )


def test_confidence(hits):
    rows = {r["query_id"]: r["low_confidence"]
            for r in retrieval.retrieval_confidence(hits).collect()}
    assert rows == {"q1": False, "q2": True}


def test_context_block(hits):
    rows = {r["query_id"]: r["context"] for r in retrieval.build_context(hits).collect()}
    assert rows["q1"] == (
        "[Source 1: a.txt | Hazard: Flood | similarity=0.92]\nfirst\n\n---\n\n"
        "[Source 2: b.txt | similarity=0.78]\nsecond\n\n---\n\n"
        "[Source 3: a.txt | Hazard: Flood | similarity=0.78]\nthird"
    )
    # as the binary value prints, not as the decimal rounds
    assert rows["q2"] == f"[Source 1: Unknown source | similarity={0.345:.2f}]\nweak"


def test_citations_keep_the_first_hit_of_a_source(hits):
    rows = [(r["source"], r["rank"]) for r in dicts(retrieval.citations(hits).orderBy("rank"))]
    assert rows == [("a.txt", 1), ("b.txt", 2)]


def test_table_text(spark):
    df = spark.range(30).select(
        F.when(F.col("id") < 27, "big").otherwise("small").alias("g"), "id",
        F.when(F.col("id") != 28, F.col("id") * 2).alias("twice"),
    )
    rows = {r["g"]: r["table_text"] for r in
            retrieval.rows_to_text(df, "g", ["id"], ["id", "twice"]).collect()}
    big = rows["big"].split("\n")
    assert big[0] == "id | twice" and big[1] == "-" * 10
    assert big[2] == "0 | 0" and big[26] == "24 | 48"
    assert big[27] == "... (2 more rows truncated)"
    assert rows["small"].split("\n")[2:] == ["27 | 54", "28 | ", "29 | 58"]
