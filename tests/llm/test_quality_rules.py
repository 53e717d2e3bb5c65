from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import quality_rules as q
from tests.llm.conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "na " * 30_000
TEXTS = [
    None, "", " \n\t ", "one", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\nx \n y",
    "Straße über # $ | <b>", "same line\nsame line\nother", LONG,
    " ".join(f"word{i}" for i in range(60)), " ".join(f"WORD{i}" for i in range(60)),
    " | ".join(f"cell{i}" for i in range(60)),
]


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3)
               if windows[tuple(words[i:i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines), len(lines) - len(set(lines)), len(covered))


def test_measurements_equal_brute_force(spark):
    rows = q.ledger(documents(spark, TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert tuple(r[c] for c in q.MEASURES[:6]) == brute(TEXTS[r["doc_id"]])


def test_policies_are_masks_over_one_ledger(spark):
    rows = {r["doc_id"]: r for r in q.ledger(documents(spark, TEXTS)).withColumns(
        {p: q.passes(p) for p in q.POLICIES}).collect()}
    plain, upper, table = (rows[len(TEXTS) - k] for k in (3, 2, 1))
    assert plain["failures"] == 0 and plain["v3"]
    assert upper["v2"] and not upper["v3"]
    assert table["v1"] and not table["v2"]
    assert not rows[0]["v1"] and rows[10]["failures"] & q.mask_of(["repeated_windows"])


def test_apply_policy_keeps_columns_and_rows(spark):
    docs = documents(spark, [TEXTS[11]] * 2 + TEXTS).withColumn("n_words", F.lit("mine"))
    kept = q.apply_policy(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 13]
    assert {r["n_words"] for r in kept.collect()} == {"mine"}


def test_ablation_counts(spark):
    rows = {r["rule"]: r for r in q.ablation(q.ledger(documents(spark, TEXTS))).collect()}
    masks = [r["failures"] for r in q.ledger(documents(spark, TEXTS)).collect()]
    for bit, rule in enumerate(q.RULES):
        assert rows[rule]["failed"] == sum(m >> bit & 1 for m in masks)
        assert rows[rule]["only"] == sum(m == 1 << bit for m in masks)
        assert rows[rule]["kept_without"] == sum(m in (0, 1 << bit) for m in masks)


def test_empty_table_and_no_python(spark):
    empty = documents(spark, [])
    assert q.ledger(empty).count() == 0 and q.ablation(q.ledger(empty)).count() == 0
    plan = q.ledger(empty)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["n_words", "failures", "text"])
def test_null_columns(spark, name):
    docs = documents(spark, TEXTS).withColumn(name, F.lit(None).cast("string"))
    assert q.ledger(docs).count() == len(TEXTS)


@pytest.mark.parametrize("name", ["_n", "_words", "_hashes", "_own_n_words", "N_WORDS", "Failures"])
def test_own_columns_come_back_unchanged(spark, name):
    docs = documents(spark, TEXTS).withColumn(name, F.lit("mine"))
    if name == "_own_n_words":
        docs = docs.withColumn("n_words", F.lit("mine too"))
    kept = q.apply_policy(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and {r[name] for r in rows} == {"mine"}
    plain = q.apply_policy(documents(spark, TEXTS)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain)
