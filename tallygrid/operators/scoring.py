"""Scoring of answers and roll-ups of judged cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as words
from ..functions.numeric import mean, rounded
from ..functions.sizing import spread
from ..functions.text import any_contained, count_contained, occurrences

DIMENSIONS = ("faithfulness", "relevance", "groundedness")
RUBRIC = (
    "domain_vocab", "data_citation", "analytical_depth", "appropriate_caveats",
    "format_compliance",
)


def rubric_score(
    answers: DataFrame, text: str = "text", references: str = "references",
    terms: Sequence[str] = words.DOMAIN_TERMS, depth: Sequence[str] = words.DEPTH_PHRASES,
    caveats: Sequence[str] = words.CAVEAT_PHRASES,
) -> DataFrame:
    """Five dimensions of 0 to 2 and their total, by phrases found in the answer.

    ``references`` is an array of values the answer should cite.
    """
    out = spread(answers).withColumn("_lower", F.lower(text))
    lower, body = F.col("_lower"), F.col(text)
    wanted = F.col(references)
    cited = F.size(F.filter(wanted, lambda v: F.contains(lower, F.lower(v))))
    structured = (
        body.contains("1.")
        | body.contains("•")
        | (occurrences(body, "-") > 2)
        | (occurrences(body, "\n\n") > 1)
    )

    def half_hits(phrases: Sequence[str]) -> Column:
        hits = count_contained(lower, [p.lower() for p in phrases])
        return F.least(F.lit(2), F.floor(hits / 2).cast("int"))

    scored = out.withColumn("_cited", cited).withColumns(
        {
            "domain_vocab": half_hits(terms),
            "data_citation": F.when(F.col("_cited") >= F.size(wanted) * 0.6, 2)
            .when(F.col("_cited") > 0, 1)
            .otherwise(0),
            "analytical_depth": half_hits(depth),
            "appropriate_caveats": F.when(any_contained(lower, caveats), 2).otherwise(0),
            "format_compliance": F.when(structured, 2).otherwise(1),
        }
    )
    total = sum((F.col(c) for c in RUBRIC[1:]), F.col(RUBRIC[0]))
    return scored.withColumn("total", total).drop("_lower", "_cited")


def model_delta(
    scores: DataFrame, case: str, model: str, base: str, other: str, total: str = "total"
) -> DataFrame:
    """Difference of two models' totals per case, with its verdict."""
    delta = F.col("other_total") - F.col("base_total")
    return (
        scores.groupBy(case)
        .agg(
            F.max(F.when(F.col(model) == base, F.col(total))).alias("base_total"),
            F.max(F.when(F.col(model) == other, F.col(total))).alias("other_total"),
        )
        .na.fill(0, ["base_total", "other_total"])
        .withColumn("delta", delta)
        .withColumn(
            "verdict",
            F.when(F.col("delta") <= 1, "negligible")
            .when(F.col("delta") == 2, "minor")
            .otherwise("significant"),
        )
    )


JUDGEMENT = T.StructType(
    [
        field
        for d in DIMENSIONS
        for field in (
            T.StructField(d, T.DoubleType()), T.StructField(f"{d}_reason", T.StringType())
        )
    ]
    + [T.StructField("_bad", T.StringType())]
)


def strip_fences(raw: Column) -> Column:
    """Without one opening code fence, with or without "json", and one closing fence."""

    def strip(text: Column) -> Column:
        return F.regexp_replace(text, r"^\s+|\s+$", "")

    opened = F.regexp_replace(F.regexp_replace(strip(raw), "^```json", ""), "^```", "")
    return strip(F.regexp_replace(opened, "```$", ""))


def parse_judgements(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Scores of a judge's JSON reply; a reply that does not parse scores zero."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    out = df.withColumn("_clean", strip_fences(F.col(raw)))
    out = out.withColumn("_scores", F.from_json("_clean", JUDGEMENT, options))
    good = F.col("_scores").isNotNull() & F.col("_scores._bad").isNull()
    reason = F.when(good, F.coalesce(F.col("_scores.faithfulness_reason"), F.lit("")))
    return out.withColumns(
        {
            **{
                d: F.when(good, F.coalesce(F.col(f"_scores.{d}"), F.lit(0.0))).otherwise(0.0)
                for d in DIMENSIONS
            },
            "reason": reason.otherwise(
                F.concat(F.lit("Parse error: "), F.substring("_clean", 1, 80))
            ),
            "parsed": good,
        }
    ).drop("_clean", "_scores")


def eval_verdicts(
    judged: DataFrame, passing: float = words.PASS_SCORE, warning: float = words.WARN_SCORE
) -> DataFrame:
    """Mean of the three scores, rounded, and its verdict."""
    average = sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0])) / 3
    return judged.withColumn("avg_score", rounded(average, 2)).withColumn(
        "verdict",
        F.when(F.col("avg_score") >= passing, "PASS")
        .when(F.col("avg_score") >= warning, "WARN")
        .otherwise("FAIL"),
    )


def _verdict_counts() -> list[Column]:
    return [
        F.count("*").alias("cases"),
        rounded(mean(F.col("avg_score")), 2).alias("avg_score"),
        F.count_if(F.col("verdict") == "PASS").alias("passed"),
        F.count_if(F.col("verdict") == "WARN").alias("warned"),
        F.count_if(F.col("verdict") == "FAIL").alias("failed"),
    ]


def eval_overall(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(*_verdict_counts())


def eval_by_tool(verdicts: DataFrame, tool: str = "tool") -> DataFrame:
    """Cases, mean score and verdict counts per tool."""
    return verdicts.groupBy(tool).agg(*_verdict_counts())


def eval_by_dimension(judged: DataFrame) -> DataFrame:
    """Mean score per dimension."""
    means = judged.agg(*[mean(F.col(d)).alias(d) for d in DIMENSIONS])
    return means.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(d).alias("dimension"), rounded(F.col(d), 2).alias("avg_score")
                    )
                    for d in DIMENSIONS
                ]
            )
        )
    )


def grounding_check(
    answers: DataFrame, results: DataFrame, key: str, answer: str = "answer",
    name: str = "entity_name",
) -> DataFrame:
    """Does the answer mention a name from the result rows of the same question?

    One answer per key; the output of the join is one row per result row.
    """
    short = F.split_part(F.lower(F.col(name)), F.lit(" county"), F.lit(1))
    hit = F.contains(F.lower(F.col(answer)), short)
    return (
        results.select(key, name)
        .join(answers.select(key, answer), key)
        .groupBy(key)
        .agg(
            F.count("*").alias("names"),
            F.count_if(hit).alias("mentioned"),
            F.bool_or(hit).alias("is_grounded"),
        )
    )


def backtick_lint(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Flag answers that put numbers in backticks."""
    return answers.withColumn("has_backtick_number", F.col(answer).rlike(words.BACKTICK_NUMBER))
