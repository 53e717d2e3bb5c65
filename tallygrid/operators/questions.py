"""Tagging a log of questions with native column expressions.

Every function is map-only: it adds columns to ``(…, question)`` rows.  The order of
rules is part of their meaning.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import vocabulary as words
from ..functions.text import any_contained, any_match, first_contained, longest_first, lookup

ALL = "all"


def _by_script(text: Column, match: Callable[[str], Column]) -> Column:
    """``match`` with plain classes on ASCII text, with Unicode ones elsewhere.

    Word, digit and space classes must cover Unicode, but then match far more slowly;
    on ASCII text both give the same.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, match("")).otherwise(match("(?U)"))


def _all_matches(text: Column, pattern: str) -> Column:
    return _by_script(
        text, lambda flag: F.regexp_extract_all(text, F.lit(flag + pattern), F.lit(1))
    )


def _found(text: Column, pattern: str) -> Column:
    return _by_script(text, lambda flag: text.rlike(flag + pattern))


def _group(text: Column, pattern: str, index: int = 1) -> Column:
    return _by_script(text, lambda flag: F.regexp_extract(text, flag + pattern, index))


def _with_lower(df: DataFrame, question: str) -> DataFrame:
    """The lower-cased question as a column, computed once for all rules."""
    return df.withColumn("_lower", F.lower(question))


def _any_signal(text: Column, patterns: Sequence[str]) -> Column:
    return _by_script(text, lambda flag: any_match(text, patterns, flag))


def extract_years(
    questions: DataFrame, first: int = words.FIRST_YEAR, last: int = words.LAST_YEAR,
    question: str = "question",
) -> DataFrame:
    """Year range: two or more years give their span, one runs to ``last``, none is all.

    A single year after ``last`` gives just that year, never an inverted range.
    """
    years = F.transform(
        _all_matches(F.col(question), words.YEAR_20XX), lambda y: y.cast("int")
    )
    out = questions.withColumn("_years", years)
    found = F.col("_years")
    start = F.when(F.size(found) > 0, F.array_min(found)).otherwise(first)
    end = (
        F.when(F.size(found) >= 2, F.array_max(found))
        .when(F.size(found) == 1, F.greatest(F.array_min(found), F.lit(last)))
        .otherwise(last)
    )
    return out.withColumns({"start_year": start, "end_year": end}).drop("_years")


def extract_limit(
    questions: DataFrame, default: int = 10, question: str = "question"
) -> DataFrame:
    """Row limit: "top N" or "N count…", 1 for one superlative county, else the default."""
    q = F.col(question)
    first, second = _group(q, words.LIMIT, 1), _group(q, words.LIMIT, 2)
    asked = F.when(first != "", first).when(second != "", second).try_cast("int")
    single = (
        _found(q, words.SINGULAR) & ~_found(q, words.PLURAL) & _found(q, words.SUPERLATIVE)
    )
    limit = F.coalesce(asked, F.when(single, 1).otherwise(default))
    return questions.withColumn("row_limit", limit)


def extract_category(questions: DataFrame, question: str = "question") -> DataFrame:
    """Category of the longest phrase in the question, else "all"."""
    phrases = longest_first(words.CATEGORY_PHRASES)
    category = first_contained(F.col("_lower"), phrases, ALL)
    return _with_lower(questions, question).withColumn("category", category).drop("_lower")


def _state_name(lower: Column) -> Column:
    """Longest state name in the text as whole words, or NULL.

    One alternation finds all names; no name overlaps the start of a longer one.
    """
    ranked = list(longest_first(words.STATES))
    names = F.array(*[F.lit(name) for name in ranked])
    found = _all_matches(lower, rf"\b({'|'.join(ranked)})\b")
    first = F.array_min(F.transform(found, lambda name: F.array_position(names, name)))
    return F.get(names, first.cast("int") - 1)


def extract_group(questions: DataFrame, question: str = "question") -> DataFrame:
    """Full state name: written out, or a code after a comma, "in" or "County"."""
    codes = {code: name for name, code in words.STATES.items()}
    by_code = lookup(codes, _group(F.col(question), words.STATE_CODE))
    state = F.initcap(F.coalesce(_state_name(F.col("_lower")), by_code, F.lit("")))
    return _with_lower(questions, question).withColumn("group_name", state).drop("_lower")


def extract_entity(questions: DataFrame, question: str = "question") -> DataFrame:
    """First 5-digit code, else the name before "County", else NULL."""
    q = F.col(question)
    code, name = _group(q, words.FIPS), F.trim(_group(q, words.COUNTY_NAME))
    return questions.withColumn(
        "entity", F.when(code != "", code).when(name != "", name)
    )


def extract_entities(questions: DataFrame, question: str = "question") -> DataFrame:
    """All codes and county names of a question, in order: what a comparison compares."""
    q = F.col(question)
    names = F.transform(_all_matches(q, words.COUNTY_NAME), F.trim)
    codes = _all_matches(q, words.FIPS)
    return questions.withColumn("entities", F.array_distinct(F.concat(codes, names)))


def period_split(df: DataFrame, start: str = "start_year", end: str = "end_year") -> DataFrame:
    """Two halves of a year range; the first half takes the middle year."""
    middle = F.floor((F.col(start) + F.col(end)) / 2).cast("int")
    return df.withColumns(
        {
            "period_a_start": F.col(start),
            "period_a_end": middle,
            "period_b_start": middle + 1,
            "period_b_end": F.col(end),
        }
    )


def tag_template(
    questions: DataFrame, default_limit: int = 10, question: str = "question"
) -> DataFrame:
    """Report name and its parameters per question.

    An ordered pattern list chooses the report; a named category, a tracked category or a
    state scope then moves it to a narrower one.
    """
    lower = F.col("_lower")
    chain = None
    for name, pattern in words.REPORT_PATTERNS:
        hit = _found(lower, pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    out = extract_category(extract_limit(extract_years(questions, question=question),
                                         default_limit, question), question)
    out = period_split(
        _with_lower(out, question).withColumns(
            {
                "_report": chain.otherwise(words.DEFAULT_REPORT),
                "_state": _state_name(lower),
                "_scoped": _found(lower, words.GROUP_SCOPE),
            }
        )
    )
    report, named = F.col("_report"), F.col("category") != ALL
    tracked = F.col("category").isin(list(words.TRACKED_CATEGORIES))
    in_state = F.col("_state").isNotNull() & F.col("_scoped")
    template = (
        F.when((report == "largest_increase") & named, "category_increase")
        .when((report == "top_entities_by_score") & named, "top_entities_by_category")
        .when((report == "yearly_trend") & named & tracked, "category_trend")
        .when((report == "yearly_trend") & named, "category_trend_specific")
        .when((report == "top_entities_by_score") & in_state, "top_entities_in_group")
        .otherwise(report)
    )
    out = out.withColumn("template", template)
    kind = F.col("template")
    order = (
        F.when(any_contained(lower, words.SEVERE_WORDS), "total_severe")
        .when(any_contained(lower, words.MINOR_WORDS), "total_minor")
        .otherwise("total_events")
    )
    increase = kind.isin("largest_increase", "category_increase")
    periods = ["period_a_start", "period_a_end", "period_b_start", "period_b_end"]
    return out.withColumns(
        {
            "order_col": F.when(kind == "top_entities_by_category", order),
            "group_name": F.when(kind == "top_entities_in_group", F.col("_state")),
            **{p: F.when(increase, F.col(p)) for p in periods},
        }
    ).drop("_lower", "_report", "_state", "_scoped")


def route_questions(questions: DataFrame, question: str = "question") -> DataFrame:
    """Tools that answer a question, and whether it takes two.

    A prediction needs a county: without one, mixed questions stay analytic.  Analytics
    and explanation combine only on a strong wish for explanation.
    """
    q, lower = F.col(question), F.col("_lower")
    out = _with_lower(questions, question).withColumns(
        {
            "_predict": _any_signal(lower, words.PREDICT_SIGNALS),
            "_query": _any_signal(lower, words.QUERY_SIGNALS),
            "_ask": _any_signal(lower, words.ASK_SIGNALS),
            "_county": _found(q, words.FIPS) | _found(q, words.COUNTY_NAME),
        }
    )
    predict, query, ask = F.col("_predict"), F.col("_query"), F.col("_ask")

    def tools(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in names])

    chosen = (
        F.when(predict & query & F.col("_county"), tools("predict", "query"))
        .when(predict & query, tools("query"))
        .when(query & ask, tools("query", "ask"))
        .when(predict, tools("predict"))
        .when(query, tools("query"))
        .otherwise(tools("ask"))
    )
    return (
        out.withColumn("tools", chosen)
        .withColumn("is_hybrid", F.size("tools") > 1)
        .drop("_lower", "_predict", "_query", "_ask", "_county")
    )


def screen_questions(questions: DataFrame, question: str = "question") -> DataFrame:
    """Does the question look like an SQL statement?"""
    return questions.withColumn(
        "is_injection", _any_signal(F.col(question), words.INJECTION_PATTERNS)
    )


def _outside_years(question: Column, first: int, last: int) -> Column:
    years = F.transform(_all_matches(question, words.YEAR_ANY), lambda y: y.cast("int"))
    outside = F.filter(years, lambda y: (y < first) | (y > last))
    return F.array_sort(F.array_distinct(outside))


def coverage_flags(
    questions: DataFrame, first: int = words.FIRST_YEAR, last: int = words.LAST_YEAR,
    question: str = "question",
) -> DataFrame:
    """Years a question names outside the covered range, and whether there are any."""
    return questions.withColumn(
        "years_outside", _outside_years(F.col(question), first, last)
    ).withColumn("is_outside", F.size("years_outside") > 0)


def quality_notes(
    questions: DataFrame, template: str = "template", rows: str = "row_count",
    all_zero: str = "all_zero", first: int = words.FIRST_YEAR, last: int = words.LAST_YEAR,
    question: str = "question",
) -> DataFrame:
    """One note code per answered question; the first limitation that applies.

    Codes: ``years`` outside coverage, ``not_filtered`` by the named category,
    ``storm_record`` / ``fire_record`` incomplete, ``frequency`` is not risk, ``all_zero``.
    """
    lower = F.col("_lower")
    report = F.col(template)
    out = _with_lower(extract_category(questions, question), question).withColumn(
        "_outside", F.size(_outside_years(F.col(question), first, last)) > 0
    )
    category = F.col("category")
    named = category != ALL
    note = (
        F.when(F.col("_outside"), "years")
        .when(F.col(rows) == 0, "")
        .when(named & ~report.isin(list(words.CATEGORY_REPORTS)), "not_filtered")
        .when((category == "Tropical Storm") & report.isin(list(words.STORM_REPORTS)),
              "storm_record")
        .when((category == "Wildfire") & report.isin(list(words.FIRE_REPORTS)), "fire_record")
        .when(named & (report == "top_entities_by_category")
              & any_contained(lower, words.RISK_WORDS), "frequency")
        .when(F.col(all_zero), "all_zero")
        .otherwise("")
    )
    return out.withColumn("note", note).drop("_outside", "_lower")


def _is_nonzero(df: DataFrame, columns: Sequence[str]) -> Column:
    nonzero = F.lit(False)
    for c in columns:
        if c in df.columns:
            nonzero = nonzero | (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) != 0)
    return nonzero


def all_zero_checks(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row per named list of columns, all in one scan: is every one that exists zero, or no
    number, in every row?"""
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(_is_nonzero(df, c)).alias(f"n{i}") for i, c in enumerate(groups.values())])
    checks = [
        F.struct(
            F.lit(name).alias("columns"), "rows", F.col(f"n{i}").alias("nonzero_rows"),
            (F.lit(any(c in df.columns for c in columns)) & (F.col("rows") > 0)
             & (F.col(f"n{i}") == 0)).alias("all_zero"))
        for i, (name, columns) in enumerate(groups.items())
    ]
    return counts.select(F.inline(F.array(*checks)))


def all_zero_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: is every listed column that exists zero (or no number) in every row?"""
    return all_zero_checks(df, {"": columns}).drop("columns")


def observed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``df`` with its rows, and those that are not zero in ``columns``, counted as it runs."""
    seen = Observation()
    return df.observe(
        seen, F.count(F.lit(1)).alias("rows"),
        F.count_if(_is_nonzero(df, columns)).alias("nonzero_rows")), seen


def routing_distribution(routed: DataFrame) -> DataFrame:
    """Questions per tool combination."""
    return routed.groupBy(F.array_join("tools", "+").alias("tools")).agg(
        F.count("*").alias("questions"), F.count_if(F.col("is_hybrid")).alias("hybrid")
    )
