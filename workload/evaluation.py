"""Answers, judged cases and classifier evaluation over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid import vocabulary as words
from tallygrid.functions.numeric import rounded
from tallygrid.operators import modeling, scoring
from workload.gold import mean, table

# Fragments that do occur in the invented prose, in place of the domain vocabulary.
TERMS = ("the", "tion", "eaux", "keit", "and", "que", "FEMA", "ing", "ver", "county")
DEPTH = ("because", "oner", "ich", "elle", "thin", "likely", "ent")
CAVEATS = ("may not", "caveat", "period", "erth", "zuein")


def _answers(spark, sf_dir):
    """Documents as answers; the values to cite are cut from text, language and source."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.array(
            F.col("lang"), F.substring(text, 5, 4), F.substring(text, 20, 6),
            F.col("source"), F.lit("zzz"),
        ).alias("references"),
    )


def _rubric(spark, sf_dir):
    rows = scoring.rubric_score(
        _answers(spark, sf_dir), terms=TERMS, depth=DEPTH, caveats=CAVEATS
    )
    return rows.select("doc_id", *scoring.RUBRIC, "total")


def _delta(spark, sf_dir):
    """Two models: the turns of a conversation at an even and at an odd place."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    scored = scoring.rubric_score(
        turns.select(
            "conv_id",
            F.when(F.col("turn") % 4 == 1, "base").otherwise("other").alias("model"),
            "text",
            F.array(F.lit("the"), F.lit("que"), F.lit("und")).alias("references"),
        ),
        terms=TERMS, depth=DEPTH, caveats=CAVEATS,
    )
    return scoring.model_delta(scored, "conv_id", "model", "base", "other")


def judge_log(spark, sf_dir):
    """One judged case per assistant turn; scores and the reply's form follow from the text."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    size, place = F.length("text"), F.col("conv_id") + F.col("turn")
    body = F.concat(
        F.lit('{"faithfulness": '), (size % 6).cast("string"),
        F.lit(', "faithfulness_reason": "chars '), size.cast("string"),
        F.lit('", "relevance": '), (F.floor(size / 7) % 6).cast("string"),
        F.lit(', "relevance_reason": "", "groundedness": '), (place % 6).cast("string"),
        F.lit(', "groundedness_reason": ""'),
    )
    raw = (
        F.when(place % 4 == 0, F.concat(body, F.lit("}")))
        .when(place % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("}\n```")))
        .when(place % 4 == 2, F.concat(F.lit("  ```\n"), body, F.lit("}```\n")))
        .otherwise(body)
    )
    tool = (
        F.when(F.col("conv_id") % 3 == 0, "query")
        .when(F.col("conv_id") % 3 == 1, "ask")
        .otherwise("predict")
    )
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), tool.alias("tool"),
        raw.alias("raw"),
    )


def _judged(spark, sf_dir):
    return scoring.parse_judgements(judge_log(spark, sf_dir))


def _parsed(spark, sf_dir):
    return _judged(spark, sf_dir).select(
        "case_id", "parsed", "reason", *scoring.DIMENSIONS
    )


def _verdicts(spark, sf_dir):
    return scoring.eval_verdicts(_judged(spark, sf_dir)).select(
        "case_id", "tool", "avg_score", "verdict"
    )


def _by_tool(spark, sf_dir):
    verdicts = scoring.eval_verdicts(_judged(spark, sf_dir))
    overall = scoring.eval_overall(verdicts).withColumn("tool", F.lit("all"))
    return scoring.eval_by_tool(verdicts).unionByName(overall)


def _by_dimension(spark, sf_dir):
    return scoring.eval_by_dimension(_judged(spark, sf_dir))


def _grounding(spark, sf_dir):
    """Does an assistant turn repeat a word of the user turn before it?"""
    turns = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", F.col("conv_id"), F.col("turn"))
    answers = turns.filter(F.col("role") == "assistant").select(
        key.alias("question_id"), F.col("text").alias("answer")
    )
    asked = turns.filter(F.col("role") == "user").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn") + 1).alias("question_id"),
        F.explode(F.split("text", "[^a-zA-Z]+")).alias("entity_name"),
    )
    named = asked.filter(F.length("entity_name") > 4).withColumn(
        "entity_name", F.concat("entity_name", F.lit(" County"))
    )
    return scoring.grounding_check(answers, named, "question_id")


def _lint(spark, sf_dir):
    """Document texts with every digit group put in backticks in every second document."""
    quoted = F.regexp_replace("text", "([0-9]+)", "`$1`")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, quoted).otherwise(F.col("text")).alias("answer")
    )
    return scoring.backtick_lint(rows).select("doc_id", "has_backtick_number")


def _predictions(spark, sf_dir):
    """Three classes: quality plus toxicity, guessed from the length of the document."""
    size = F.col("n_chars")
    guess = F.when(size >= 3000, 2).when(size >= 500, 1).otherwise(0)
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
        .select((F.col("quality") + F.col("toxic")).alias("label"), guess.alias("prediction"))
    )


def _confusion(spark, sf_dir):
    return modeling.confusion_matrix(_predictions(spark, sf_dir))


def _grid(spark, sf_dir):
    return modeling.confusion_grid(
        modeling.confusion_matrix(_predictions(spark, sf_dir)), [0, 1, 2]
    )


def _report(spark, sf_dir):
    rows = modeling.classification_report(_predictions(spark, sf_dir))
    return rows.select(
        "class", "support",
        *[rounded(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")],
    )


def _metrics_rows(spark, sf_dir):
    return modeling.classification_metrics(_predictions(spark, sf_dir))


def _metrics(spark, sf_dir):
    rows = _metrics_rows(spark, sf_dir)
    return rows.select([rounded(F.col(c), 6).alias(c) for c in rows.columns])


def _gate(spark, sf_dir):
    rows = modeling.quality_gate(_metrics_rows(spark, sf_dir), 0.4)
    return rows.withColumn("balanced_accuracy", rounded(F.col("balanced_accuracy"), 6))


def _distribution(spark, sf_dir):
    tiers = F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH"))
    rows = _predictions(spark, sf_dir).withColumn("risk_bucket", tiers[F.col("prediction")])
    return modeling.bucket_distribution(rows)


QUERIES = {
    "rubric_score": _rubric,
    "model_delta": _delta,
    "parse_judgements": _parsed,
    "eval_verdicts": _verdicts,
    "eval_by_tool": _by_tool,
    "eval_by_dimension": _by_dimension,
    "grounding_check": _grounding,
    "backtick_lint": _lint,
    "confusion_matrix": _confusion,
    "confusion_grid": _grid,
    "classification_report": _report,
    "classification_metrics": _metrics,
    "quality_gate": _gate,
    "bucket_distribution": _distribution,
}


def _hits(phrases) -> str:
    return " + ".join(
        f"CASE WHEN contains(low, '{p.lower()}') THEN 1 ELSE 0 END" for p in phrases
    )


def _rubric_sql(source: str) -> str:
    caveat = " OR ".join(f"contains(low, '{p}')" for p in CAVEATS)
    return f"""cited AS (SELECT *, lower(text) AS low,
  len(list_filter(refs, lambda v: contains(lower(text), lower(v)))) AS hits FROM {source}),
marks AS (SELECT *, CAST(least(2, floor(({_hits(TERMS)}) / 2.0)) AS INTEGER) AS domain_vocab,
  CASE WHEN hits >= len(refs) * 0.6 THEN 2 WHEN hits > 0 THEN 1 ELSE 0 END AS data_citation,
  CAST(least(2, floor(({_hits(DEPTH)}) / 2.0)) AS INTEGER) AS analytical_depth,
  CASE WHEN {caveat} THEN 2 ELSE 0 END AS appropriate_caveats,
  CASE WHEN contains(text, '1.') OR contains(text, '•')
    OR length(text) - length(replace(text, '-', '')) > 2
    OR (length(text) - length(replace(text, chr(10) || chr(10), ''))) / 2 > 1
    THEN 2 ELSE 1 END AS format_compliance FROM cited),
scored AS (SELECT *, domain_vocab + data_citation + analytical_depth + appropriate_caveats
  + format_compliance AS total FROM marks)"""


_JUDGED = f"""judged AS (SELECT conv_id || '-' || turn AS case_id,
  CASE conv_id % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'ask' ELSE 'predict' END AS tool,
  (conv_id + turn) % 4 < 3 AS parsed,
  CASE WHEN (conv_id + turn) % 4 < 3 THEN 'chars ' || length(text)
    ELSE 'Parse error: ' || substring('{{"faithfulness": ' || length(text) % 6
      || ', "faithfulness_reason": "chars ' || length(text) || '", "relevance": '
      || (length(text) // 7) % 6 || ', "relevance_reason": ""', 1, 80) END AS reason,
  CASE WHEN (conv_id + turn) % 4 < 3 THEN CAST(length(text) % 6 AS DOUBLE) ELSE 0 END
    AS faithfulness,
  CASE WHEN (conv_id + turn) % 4 < 3 THEN CAST((length(text) // 7) % 6 AS DOUBLE) ELSE 0 END
    AS relevance,
  CASE WHEN (conv_id + turn) % 4 < 3 THEN CAST((conv_id + turn) % 6 AS DOUBLE) ELSE 0 END
    AS groundedness
  FROM conversations WHERE role = 'assistant'),
averaged AS (SELECT *, ROUND((faithfulness + relevance + groundedness) / 3, 2) AS avg_score
  FROM judged),
verdicts AS (SELECT *, CASE WHEN avg_score >= {words.PASS_SCORE} THEN 'PASS'
  WHEN avg_score >= {words.WARN_SCORE} THEN 'WARN' ELSE 'FAIL' END AS verdict FROM averaged)"""

_COUNTS = f"""COUNT(*) AS cases, ROUND({mean("avg_score")}, 2) AS avg_score,
  COUNT(*) FILTER (WHERE verdict = 'PASS') AS passed,
  COUNT(*) FILTER (WHERE verdict = 'WARN') AS warned,
  COUNT(*) FILTER (WHERE verdict = 'FAIL') AS failed FROM verdicts"""

_PRED = """pred AS (SELECT quality + toxic AS label,
  CASE WHEN n_chars >= 3000 THEN 2 WHEN n_chars >= 500 THEN 1 ELSE 0 END AS prediction
  FROM labels JOIN documents USING (doc_id))"""

_CLASSES = f"""WITH {_PRED},
classes AS (SELECT label AS class FROM pred UNION SELECT prediction FROM pred),
counted AS (SELECT class,
  (SELECT COUNT(*) FROM pred WHERE label = class) AS support,
  (SELECT COUNT(*) FROM pred WHERE prediction = class) AS called,
  (SELECT COUNT(*) FROM pred WHERE label = class AND prediction = class) AS hits FROM classes),
rates AS (SELECT class, support, hits,
  CASE WHEN called > 0 THEN CAST(hits AS DOUBLE) / called ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0 END AS recall,
  2.0 * hits / CAST(called + support AS DOUBLE) AS f1 FROM counted)"""

_BALANCED = "AVG(CASE WHEN support > 0 THEN recall END)"

ORACLES = {
    "rubric_score": f"""WITH answers AS (SELECT doc_id, text, [lang, substring(text, 5, 4),
  substring(text, 20, 6), source, 'zzz'] AS refs FROM documents),
{_rubric_sql("answers")}
SELECT doc_id, {", ".join(scoring.RUBRIC)}, CAST(total AS INTEGER) AS total FROM scored""",
    "model_delta": f"""WITH answers AS (SELECT conv_id, text, ['the', 'que', 'und'] AS refs,
  CASE WHEN turn % 4 = 1 THEN 'base' ELSE 'other' END AS model
  FROM conversations WHERE role = 'assistant'), {_rubric_sql("answers")},
sides AS (SELECT conv_id, COALESCE(MAX(CASE WHEN model = 'base' THEN total END), 0) AS b,
  COALESCE(MAX(CASE WHEN model = 'other' THEN total END), 0) AS o FROM scored GROUP BY conv_id)
SELECT conv_id, CAST(b AS INTEGER) AS base_total, CAST(o AS INTEGER) AS other_total,
  CAST(o - b AS INTEGER) AS delta, CASE WHEN o - b <= 1 THEN 'negligible'
  WHEN o - b = 2 THEN 'minor' ELSE 'significant' END AS verdict FROM sides""",
    "parse_judgements": f"""WITH {_JUDGED}
SELECT case_id, parsed, reason, faithfulness, relevance, groundedness FROM judged""",
    "eval_verdicts": f"WITH {_JUDGED} SELECT case_id, tool, avg_score, verdict FROM verdicts",
    "eval_by_tool": f"""WITH {_JUDGED}
SELECT tool, {_COUNTS} GROUP BY tool UNION ALL SELECT 'all', {_COUNTS}""",
    "eval_by_dimension": f"""WITH {_JUDGED}
SELECT 'faithfulness' AS dimension, ROUND(AVG(faithfulness), 2) AS avg_score FROM judged
UNION ALL SELECT 'relevance', ROUND(AVG(relevance), 2) FROM judged
UNION ALL SELECT 'groundedness', ROUND(AVG(groundedness), 2) FROM judged""",
    "grounding_check": """WITH named AS (
  SELECT conv_id || '-' || (turn + 1) AS question_id,
    unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS word
  FROM conversations WHERE role = 'user'),
answers AS (SELECT conv_id || '-' || turn AS question_id, text FROM conversations
  WHERE role = 'assistant')
SELECT question_id, COUNT(*) AS names,
  CAST(SUM(CASE WHEN contains(lower(text), lower(word)) THEN 1 ELSE 0 END) AS BIGINT)
    AS mentioned,
  bool_or(contains(lower(text), lower(word))) AS is_grounded
FROM named JOIN answers USING (question_id) WHERE length(word) > 4 GROUP BY question_id""",
    "backtick_lint": f"""SELECT doc_id, regexp_matches(CASE WHEN doc_id % 2 = 0
  THEN regexp_replace(text, '([0-9]+)', '`\\1`', 'g') ELSE text END,
  '{words.BACKTICK_NUMBER}') AS has_backtick_number FROM documents""",
    "confusion_matrix": f"""WITH {_PRED}
SELECT label AS actual, prediction AS predicted, COUNT(*) AS rows FROM pred GROUP BY 1, 2""",
    "confusion_grid": f"""WITH {_PRED}
SELECT label AS actual, COUNT(*) FILTER (WHERE prediction = 0) AS predicted_0,
  COUNT(*) FILTER (WHERE prediction = 1) AS predicted_1,
  COUNT(*) FILTER (WHERE prediction = 2) AS predicted_2 FROM pred GROUP BY label""",
    "classification_report": f"""{_CLASSES}
SELECT class, support, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
  ROUND(f1, 6) AS f1 FROM rates""",
    "classification_metrics": f"""{_CLASSES}
SELECT ROUND(CAST(SUM(hits) AS DOUBLE) / SUM(support), 6) AS accuracy,
  ROUND({_BALANCED}, 6) AS balanced_accuracy,
  ROUND(SUM(f1 * support) / SUM(support), 6) AS f1_weighted,
  ROUND(AVG(f1), 6) AS f1_macro FROM rates""",
    "quality_gate": f"""{_CLASSES}
SELECT ROUND({_BALANCED}, 6) AS balanced_accuracy, CAST(0.4 AS DOUBLE) AS threshold,
  {_BALANCED} >= 0.4 AS publish FROM rates""",
    "bucket_distribution": f"""WITH {_PRED}
SELECT CASE prediction WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_bucket,
  COUNT(*) AS rows FROM pred GROUP BY prediction""",
}
