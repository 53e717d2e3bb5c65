"""Governed named queries: a whitelist of reports with typed, checked parameters.

Parameters never become SQL text: they are validated here and bound as literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import vocabulary as words
from ..operators import questions, ranking, resolve, trends
from ..schemas import COUNTY, Names
from .sql_guard import run_sql

MAX_LIMIT = 100
DEFAULT_LIMIT = 20
# Reports of one log that run at the same time.
REPORTS_AT_ONCE = 4

YEARS = (
    "start_year", "end_year", "period_a_start", "period_a_end", "period_b_start", "period_b_end"
)
_FIPS = re.compile(r"[0-9]{5}")

# County names of parameters and reports, accepted beside the neutral ones.
PARAMETER_ALIASES = {
    "hazard_type": "category", "state_name": "group", "county_fips_list": "ids",
    "row_limit": "limit", "group_name": "group",
}
REPORT_ALIASES = {
    "top_counties_by_risk": "top_entities_by_score",
    "top_counties_in_state": "top_entities_in_group",
    "county_comparison": "entity_comparison",
    "fema_declarations_by_state": "group_totals",
    "hazard_trend_by_year": "yearly_trend",
    "hazard_event_increase": "category_increase",
    "top_counties_by_hazard": "top_entities_by_category",
    "hazard_trend_by_feature": "category_trend",
    "hazard_trend_specific": "category_trend",
    "category_trend_specific": "category_trend",
}
ORDER_ALIASES = {"total_fatalities": "total_severe", "total_injuries": "total_minor"}

_RANGE = ("start_year", "end_year")
_PERIODS = YEARS[2:]
REQUIRED: dict[str, tuple[str, ...]] = {
    "top_entities_by_score": _RANGE,
    "top_entities_in_group": (*_RANGE, "group"),
    "entity_comparison": (*_RANGE, "ids"),
    "group_totals": _RANGE,
    "yearly_trend": _RANGE,
    "largest_increase": _PERIODS,
    "category_increase": (*_PERIODS, "category"),
    "top_entities_by_category": (*_RANGE, "category", "order_col"),
    "category_trend": (*_RANGE, "category"),
}
# Column a report is ranked by.
RANKED_BY = {
    "top_entities_by_score": "avg_loss_score",
    "top_entities_in_group": "avg_loss_score",
    "group_totals": "total_declarations",
    "largest_increase": "absolute_increase",
    "category_increase": "absolute_increase",
}


@dataclass(frozen=True)
class Parameter:
    """How a parameter is read: ``parse`` gives its canonical form, or fails with ValueError."""

    parse: Callable[[Any, "Limits"], Any]
    expects: str


@dataclass(frozen=True)
class Limits:
    """What the data at hand allows."""

    min_year: int = words.MIN_YEAR
    max_year: int = words.MAX_YEAR
    id_pattern: re.Pattern[str] = _FIPS


def _require(fine: bool) -> None:
    if not fine:
        raise ValueError


def _year(value: Any, limits: Limits) -> int:
    year = int(value)
    _require(limits.min_year <= year <= limits.max_year)
    return year


def _row_limit(value: Any, limits: Limits) -> int:
    _require(int(value) >= 1)
    return min(int(value), MAX_LIMIT)


def _text(pattern: str, canonical: Callable[[str], str] = str) -> Callable[[Any, Limits], str]:
    def parse(value: Any, limits: Limits) -> str:
        _require(re.fullmatch(pattern, str(value)) is not None)
        return canonical(str(value))

    return parse


def _id_list(value: Any, limits: Limits) -> list:
    parts = value.replace(" ", "").split(",") if isinstance(value, str) else value
    ids = [p.strip("'") if isinstance(p, str) else p for p in parts]
    _require(bool(ids) and all(limits.id_pattern.fullmatch(str(i)) for i in ids))
    return ids


def _order(value: Any, limits: Limits) -> str:
    column = ORDER_ALIASES.get(value, value)
    _require(column in ranking.ORDER_COLUMNS)
    return column


PARAMETERS: dict[str, Parameter] = {
    **{name: Parameter(_year, "a covered year") for name in YEARS},
    "limit": Parameter(_row_limit, "a positive number of rows"),
    "category": Parameter(_text(r"[a-zA-Z \-]+"), "letters, blanks and hyphens"),
    "group": Parameter(
        _text(r"[a-zA-Z ]+", lambda v: v.strip().lower()), "letters and blanks"),
    "ids": Parameter(_id_list, "entity ids"),
    "order_col": Parameter(_order, f"one of {', '.join(ranking.ORDER_COLUMNS)}"),
}


def validate(
    name: str, params: Mapping[str, Any], limits: Limits = Limits()
) -> tuple[str, dict[str, Any]]:
    """Canonical report name and clean parameters; anything doubtful raises ValueError."""
    report = REPORT_ALIASES.get(name, name)
    if report not in REQUIRED:
        raise ValueError(f"no report is called {name!r}; there are {', '.join(sorted(REQUIRED))}")
    clean: dict[str, Any] = {}
    for given, value in params.items():
        key = PARAMETER_ALIASES.get(given, given)
        if key not in PARAMETERS:
            raise ValueError(f"{report} takes no {given!r}")
        if value is None:
            continue
        try:
            clean[key] = PARAMETERS[key].parse(value, limits)
        except (TypeError, ValueError):
            expected = PARAMETERS[key].expects
            raise ValueError(f"{given} must be {expected}, not {value!r}") from None
    lacking = sorted(set(REQUIRED[report]) - set(clean))
    if lacking:
        raise ValueError(f"{report} needs {', '.join(lacking)}")
    return report, clean


def mentions(question: str) -> list[tuple[str, str | None]]:
    """County names of a question in order, each with the state that follows it, if any."""
    by_code = {code: state for state, code in words.STATES.items()}
    states = "|".join(sorted(words.STATES, key=len, reverse=True))
    after = re.compile(rf"\s*(?:,|in\b)?\s*(?:([A-Z]{{2}})\b|((?i:{states}))\b)")
    found = []
    for name in re.finditer(words.COUNTY_NAME, question):
        state = after.match(question, name.end())
        code, full = state.groups() if state else (None, None)
        hint = by_code.get(code) if code else full.lower() if full else None
        found.append((name[1].strip(), hint))
    return list(dict.fromkeys(found))


@dataclass(frozen=True)
class Answer:
    """The rows of an executed report, and whether its event figures are all zero."""

    report: str
    rows: list[Row]
    row_count: int
    all_zero: bool


@dataclass(frozen=True)
class Gold:
    """The three tables reports may read, and their column names."""

    mart: DataFrame
    events: DataFrame
    entity: DataFrame
    names: Names = COUNTY
    combined: tuple[tuple[str, ...], ...] = words.COMBINED_CATEGORIES
    min_year: int = words.MIN_YEAR
    max_year: int = words.MAX_YEAR
    id_pattern: re.Pattern[str] = _FIPS

    def run(self, name: str, **params: Any) -> DataFrame:
        """Run a named report; the result never has more than ``MAX_LIMIT`` rows."""
        limits = Limits(self.min_year, self.max_year, self.id_pattern)
        report, clean = validate(name, params, limits)
        return _REPORTS[report](self, clean)

    def sql(self, query: str, limit: int = MAX_LIMIT, database: str | None = None) -> DataFrame:
        """Rows of a free query over the tables ``mart``, ``events`` and ``entity``.

        Only plain queries over these names run (``plans.sql_guard``); ``database`` may stand
        before them.  At most ``MAX_LIMIT`` rows come back.
        """
        tables = {"mart": self.mart, "events": self.events, "entity": self.entity}
        return run_sql(tables, query, min(limit, MAX_LIMIT), database)

    def executed(self, name: str, **params: Any) -> Answer:
        """Run a report and keep its rows; they are counted in the pass that fetches them."""
        report = REPORT_ALIASES.get(name, name)
        metrics = words.METRIC_COLUMNS
        counted, seen = questions.observed(self.run(name, **params), metrics)
        rows = counted.collect()
        has_metric = any(c in counted.columns for c in metrics)
        return Answer(report, rows, len(rows),
                      has_metric and bool(rows) and seen.get["nonzero_rows"] == 0)

    def facts(self, requests: Mapping[str, Mapping[str, Any]]) -> DataFrame:
        """``(template, row_count, all_zero)`` of executed reports, a few at a time."""
        def one(item: tuple[str, Mapping[str, Any]]) -> tuple:
            done = self.executed(item[0], **item[1])
            return done.report, done.row_count, done.all_zero

        spark = self.mart.sparkSession
        with ThreadPoolExecutor(REPORTS_AT_ONCE) as pool:
            rows = list(pool.map(inheritable_thread_target(spark)(one), requests.items()))
        return spark.createDataFrame(rows, "template string, row_count int, all_zero boolean")

    def noted(self, question: str, default_limit: int = DEFAULT_LIMIT) -> tuple[Answer, str]:
        """The answer to a question, and the code of the note it needs, "" for none."""
        template, params = self._request(question, default_limit)
        done = self.executed(template, **params)
        asked = self.mart.sparkSession.createDataFrame(
            [(question, done.report, done.row_count, done.all_zero)],
            "question string, template string, row_count int, all_zero boolean")
        return done, questions.quality_notes(asked).first()["note"]

    def answer(self, question: str, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Run the report a question asks for.  A log of questions is tagged as a table."""
        template, params = self._request(question, default_limit)
        return self.run(template, **params)

    def _request(self, question: str, default_limit: int) -> tuple[str, dict[str, Any]]:
        """The report that a question asks for, and its parameters."""
        spark = self.mart.sparkSession
        asked = spark.createDataFrame([(0, question)], "lookup_id int, question string")
        tagged = questions.extract_entities(questions.tag_template(asked, default_limit))
        tags = tagged.first().asDict()
        params = {k: tags[k] for k in (*YEARS, "row_limit", "category", "order_col", "group_name")}
        if tags["template"] == "entity_comparison":
            params["ids"] = self._ids(question, tags["entities"])
        return tags["template"], params

    def _ids(self, question: str, mentioned: Sequence[str]) -> list[str]:
        """Ids among the mentioned entities, and those that the mentioned names resolve to.

        A name is looked up in the state that follows it.  Without one, a name that exists in
        several states is refused with the states to choose from.
        """
        ids = [m for m in mentioned if self.id_pattern.fullmatch(m)]
        # A word before the name may have been taken for its first part.
        named = [
            (2 * i + k, name, hint) for i, (n, hint) in enumerate(mentions(question))
            for k, name in enumerate(dict.fromkeys((n, n.split()[-1])))
        ]
        if named:
            lookups = self.mart.sparkSession.createDataFrame(
                named, "lookup_id int, name string, hint string"
            )
            unclear = lookups.filter("hint IS NULL").select(
                resolve.clean_name(F.col("name")).alias("name"))
            doubtful = resolve.ambiguous_names(self.entity, names=self.names).withColumn(
                "name", resolve.clean_name(F.col("name"))).join(unclear, "name", "left_semi")
            for row in doubtful.limit(1).collect():
                raise ValueError(f"{row['name']!r} may be in {', '.join(row['groups'])}")
            found = resolve.resolve_entity(lookups, self.entity, hint="hint", names=self.names)
            by_lookup = {r["lookup_id"]: r[self.names.entity] for r in found.collect()}
            whole = {i for i in by_lookup if i % 2 == 0}
            ids += [by_lookup[i] for i in sorted(by_lookup) if i % 2 == 0 or i - 1 not in whole]
        return list(dict.fromkeys(ids))

    def ranked_by(self, name: str, **params: Any) -> str:
        """The column a report's order comes from, or "" for time series."""
        report = REPORT_ALIASES.get(name, name)
        order = params.get("order_col")
        return ORDER_ALIASES.get(order, order) or RANKED_BY.get(report, "")


def _limit(p: Mapping[str, Any], default: int = DEFAULT_LIMIT) -> int:
    return p.get("limit", default)


def _years(p: Mapping[str, Any]) -> tuple[int, int]:
    return p["start_year"], p["end_year"]


def _periods(p: Mapping[str, Any]):
    return (
        (p["period_a_start"], p["period_a_end"]), (p["period_b_start"], p["period_b_end"])
    )


def _categories(gold: Gold, p: Mapping[str, Any]) -> list[str]:
    return ranking.expand_categories(p["category"], gold.combined)


def _top_by_category(g: Gold, p: Mapping[str, Any]) -> DataFrame:
    # A ranking by casualties never shows entities without any.
    return ranking.top_entities_by_category(
        g.events, g.entity, _categories(g, p), *_years(p), order_col=p["order_col"],
        limit=_limit(p), nonzero=p["order_col"] != "total_events", names=g.names,
    )


_REPORTS: dict[str, Callable[[Gold, Mapping[str, Any]], DataFrame]] = {
    "top_entities_by_score": lambda g, p: ranking.top_entities_by_score(
        g.mart, g.entity, *_years(p), _limit(p), g.names
    ),
    "top_entities_in_group": lambda g, p: ranking.top_entities_in_group(
        g.mart, g.entity, p["group"], *_years(p), _limit(p), g.names
    ),
    "entity_comparison": lambda g, p: ranking.entity_comparison(
        g.mart, g.entity, p["ids"], *_years(p), _limit(p, MAX_LIMIT), g.names
    ),
    "group_totals": lambda g, p: ranking.group_totals(
        g.mart, g.entity, *_years(p), _limit(p), g.names
    ),
    "yearly_trend": lambda g, p: trends.yearly_trend(
        g.mart, *_years(p), _limit(p, MAX_LIMIT), g.names
    ),
    "largest_increase": lambda g, p: trends.largest_increase(
        g.mart, g.entity, *_periods(p), _limit(p), g.names
    ),
    "category_increase": lambda g, p: trends.category_increase(
        g.events, g.entity, _categories(g, p), *_periods(p), _limit(p), g.names
    ),
    "top_entities_by_category": _top_by_category,
    "category_trend": lambda g, p: trends.category_trend(
        g.events, _categories(g, p), *_years(p), _limit(p, MAX_LIMIT), g.names
    ),
}
