from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tallygrid.llm import catalog, ngram_join, quality_model
from tallygrid.llm.quality_rules import ledger, passes
from tests.llm.conftest import documents
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = catalog.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert names.keys() <= contract.queries().keys() and "pipeline" in names
    assert catalog.oracles().keys() <= names.keys()


def words(seed, n=80):
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 997}" for i in range(n))


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    texts = [words(i) for i in range(120)] + [words(3) + " more", words(3), "too short", None,
                                              " | ".join(f"c{i}" for i in range(80))]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)],
                          "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality_rules"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in first.collect()) == list(range(122))
    second = stage["quality_classifier"](spark, first, str(tmp_path))
    third = stage["near_duplicates"](spark, second, str(tmp_path))
    assert first.columns == second.columns == third.columns == docs.columns
    left = sorted(r["doc_id"] for r in second.collect())
    assert len(left) >= 118
    keep = {left[c] for _, c in brute([texts[i] for i in left], 5, 4, 5)}
    assert {r["doc_id"] for r in third.collect()} == keep
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == keep


@pytest.mark.skipif(not Path(SF).exists(), reason="no supplied tables")
def test_clean_documents_of_the_supplied_table_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = ledger(docs).withColumn("fine", passes("v3")).join(labels, "doc_id")
    assert judged.filter("quality = 0 AND fine").count() == 0
    assert judged.filter("quality = 1 AND NOT fine AND n_words >= 50").count() <= 1


def test_empty_documents(spark, tmp_path):
    empty = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_model.keep_good(empty, labels).count() == 0
    assert ngram_join.keep_one(empty).count() == 0
