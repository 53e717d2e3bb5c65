from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import modeling, scoring

from .conftest import dicts


def test_rubric(spark):
    rows = [
        (0, "NRI and FEMA data. This suggests a pattern, likely because of scope.\n1. Harris 99",
         ["Harris", "99", "Cook"]),
        (1, "plain - text - with - dashes", ["absent"]),
        (2, "", []),
        (3, "NOAA county resilience EAL; cites Cook", ["Cook", "zzz", "qqq"]),
    ]
    df = spark.createDataFrame(rows, "id int, text string, references array<string>")
    out = {r["id"]: r for r in scoring.rubric_score(df).collect()}
    first = out[0]
    assert [first[c] for c in scoring.RUBRIC] == [1, 2, 2, 2, 2] and first["total"] == 9
    assert [out[1][c] for c in scoring.RUBRIC] == [0, 0, 0, 0, 2]
    # nothing to cite counts as cited
    assert [out[2][c] for c in scoring.RUBRIC] == [0, 2, 0, 0, 1]
    assert out[3]["domain_vocab"] == 2 and out[3]["data_citation"] == 1


def test_model_delta(spark):
    df = spark.createDataFrame(
        [(1, "a", 5), (1, "b", 6), (2, "a", 5), (2, "b", 7), (3, "a", 2), (3, "b", 6),
         (4, "a", 3)],
        "case int, model string, total int",
    )
    rows = {r["case"]: (r["delta"], r["verdict"])
            for r in scoring.model_delta(df, "case", "model", "a", "b").collect()}
    assert rows == {1: (1, "negligible"), 2: (2, "minor"), 3: (4, "significant"),
                    4: (-3, "negligible")}


@pytest.fixture(scope="module")
def judged(spark):
    good = '{"faithfulness": 5, "faithfulness_reason": "ok", "relevance": 4, "groundedness": 3}'
    rows = [
        (1, "query", good),
        (2, "query", f"```json\n{good}\n```"),
        (3, "ask", f"  ```\n{good}```\n"),
        (4, "ask", "I would rate this 5"),
        (5, "ask", good[:-1]),
        (6, "predict", good.replace("5", "3").replace("4", "2")),
    ]
    return scoring.parse_judgements(
        spark.createDataFrame(rows, "id int, tool string, raw string")
    )


def test_judgements(judged):
    rows = {r["id"]: r for r in judged.collect()}
    assert [rows[i]["parsed"] for i in range(1, 7)] == [True, True, True, False, False, True]
    assert all(rows[i]["faithfulness"] == 5 for i in (1, 2, 3))
    assert rows[1]["reason"] == "ok"
    assert rows[4]["faithfulness"] == 0 and rows[4]["reason"].startswith("Parse error: I would")


def test_verdicts_and_roll_ups(judged):
    verdicts = scoring.eval_verdicts(judged)
    rows = {r["id"]: (r["avg_score"], r["verdict"]) for r in verdicts.collect()}
    assert rows[1] == (4.0, "PASS") and rows[4] == (0.0, "FAIL") and rows[6] == (2.67, "WARN")
    tools = {r["tool"]: r for r in scoring.eval_by_tool(verdicts).collect()}
    assert (tools["ask"]["cases"], tools["ask"]["passed"], tools["ask"]["failed"]) == (3, 1, 2)
    assert tools["query"]["avg_score"] == 4.0
    overall = scoring.eval_overall(verdicts).first()
    assert (overall["cases"], overall["warned"]) == (6, 1)
    dims = {r["dimension"]: r["avg_score"] for r in scoring.eval_by_dimension(judged).collect()}
    assert dims["faithfulness"] == 3.0


def test_grounding(spark):
    answers = spark.createDataFrame(
        [(1, "harris leads, cook follows"), (2, "nobody")], "q int, answer string"
    )
    results = spark.createDataFrame(
        [(1, "Harris County"), (1, "Kings County"), (2, "Harris County"), (3, "Cook County")],
        "q int, entity_name string",
    )
    rows = {r["q"]: (r["names"], r["mentioned"], r["is_grounded"])
            for r in scoring.grounding_check(answers, results, "q").collect()}
    assert rows == {1: (2, 1, True), 2: (1, 0, False)}


def test_backticks(spark):
    df = spark.createDataFrame(
        [(1, "was `52,340` in"), (2, "`$1.5%`"), (3, "`code`"), (4, "52,340")],
        "i int, answer string",
    )
    assert [r["has_backtick_number"] for r in scoring.backtick_lint(df).collect()] == [
        True, True, False, False
    ]


# -- classification -----------------------------------------------------------------------

MATRIX = [[169, 11, 33], [41, 130, 41], [32, 38, 143]]


@pytest.fixture(scope="module")
def predicted(spark):
    rows = [(a, float(p)) for a in range(3) for p in range(3) for _ in range(MATRIX[a][p])]
    return spark.createDataFrame(rows, "label int, prediction double")


def test_published_confusion_matrix_gives_published_scores(predicted):
    grid = modeling.confusion_grid(modeling.confusion_matrix(predicted), [0, 1, 2])
    assert [list(r)[1:] for r in grid.orderBy("actual").collect()] == MATRIX
    row = modeling.classification_metrics(predicted).first()
    m = np.array(MATRIX)
    recall = m.diagonal() / m.sum(1)
    f1 = 2 * m.diagonal() / (m.sum(0) + m.sum(1))
    assert row["accuracy"] == pytest.approx(442 / 638)
    assert row["balanced_accuracy"] == pytest.approx(recall.mean())
    assert row["f1_macro"] == pytest.approx(f1.mean())
    assert row["f1_weighted"] == pytest.approx((f1 * m.sum(1)).sum() / m.sum())
    assert modeling.quality_gate(modeling.classification_metrics(predicted)).first()["publish"]


def test_class_never_predicted_and_class_never_present(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "label int, prediction int")
    rows = {r["class"]: r for r in modeling.classification_report(df).collect()}
    assert rows[1]["precision"] == 0.0 and rows[1]["recall"] == 0.0
    assert rows[2]["support"] == 0
    metrics = modeling.classification_metrics(df).first()
    assert metrics["balanced_accuracy"] == pytest.approx((0.5 + 0.0) / 2)
    assert metrics["f1_macro"] == pytest.approx((0.5 + 0 + 0) / 3)


def test_distribution(spark):
    df = spark.createDataFrame([("LOW",), ("LOW",), ("HIGH",)], "risk_bucket string")
    assert {(r["risk_bucket"], r["rows"]) for r in
            modeling.bucket_distribution(df).collect()} == {("LOW", 2), ("HIGH", 1)}


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_models_learn_a_separable_tier(spark, kind):
    df = spark.range(240).select(
        F.col("id").alias("entity_id"),
        (F.col("id") % 3).cast("int").alias("label"),
        ((F.col("id") % 3) * 10 + F.rand(1)).alias("x"),
        F.rand(2).alias("noise"),
    )
    model = modeling.train_classifier(
        df, ["x", "noise"], params={"rounds": 5, "columns": 1.0}, kind=kind
    )
    scored = modeling.batch_score(model, df, ["entity_id", "label"])
    # split points are sampled, so a value next to one may fall on the other side
    assert scored.filter("predicted_class <> label").count() <= 5
    row = scored.filter("label = 2").first()
    assert row["risk_bucket"] == "HIGH" and set(row["probabilities"]) == {
        "LOW", "MEDIUM", "HIGH"
    }
    importance = dicts(modeling.feature_importance(model, ["x", "noise"]))
    assert importance[0]["feature"] == "x"
    with pytest.raises(ValueError, match="kind"):
        modeling.train_classifier(df, ["x"], kind="linear")
