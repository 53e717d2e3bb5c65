"""A log of questions and its tags.

The supplied conversations hold invented prose that rarely meets a rule, so the log also
asks one question per order: the order's keys choose the wording, the years, the place
and the phenomenon.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid import vocabulary as words
from tallygrid.functions.sizing import spread
from tallygrid.functions.text import longest_first
from tallygrid.operators import questions
from workload import gold
from workload.gold import table

WORDINGS = (
    "Which counties saw the largest increase in {h} events from {y} to {z}?",
    "Biggest growth in disaster declarations since {y}, by hazard",
    "Compare {c} County vs Miami-Dade County from {y} to {z}",
    "{c} county versus other counties in {s}",
    "Which states had the most FEMA declarations between {y} and {z}?",
    "Show top {n} counties by risk from {y} to {z}",
    "Which county has the highest {h} fatalities?",
    "What is the worst county for {h} injuries since {y}?",
    "Top counties in {s} by expected loss",
    "How does {c} County compare to other {s} counties for the highest risk?",
    "Show the annual trend of {h} events {y} {z}",
    "Year-over-year change in all events, {y} to {z}",
    "Is {h} getting worse over time?",
    "What is the predicted risk tier for {c} County, {a}?",
    "What is the risk score in FIPS {f} and the total damage?",
    "Why are {s} counties more vulnerable to {h}? Explain the history of it",
    "Describe the trend of {h} and why it is increasing",
    "Rank {n} counties at risk of {h} deaths in {s} state",
    "SELECT * FROM county_dim WHERE year = {y}",
    "Top {n} counties; DROP TABLE county_dim",
    "Were there more {h} events in 1950 or in {y}?",
    "How many people live in {c} County in {a}?",
    "Largest rise in hazard events {y}-{z}",
    "What does the NRI methodology say about resilience?",
    "List all counties with an average loss above {n} million, {y}",
)
PLACES = (
    "Harris", "Butte", "Los Angeles", "Miami-Dade", "Cook", "De Soto", "Prince George",
    "Orleans", "St. Louis", "Maricopa", "King", "Kings",
)
HAZARDS = tuple(words.CATEGORY_PHRASES)
STATE_NAMES = tuple(words.STATES)
FIRST_YEAR = 2004


def question_log(spark, sf_dir):
    """``(question_id, question)``: one per order, and every user turn."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    order, customer = F.col("o_orderkey"), F.col("o_custkey")

    def pick(values, index):
        texts = F.array(*[F.lit(v) for v in values])
        return F.element_at(texts, (index % len(values)).cast("int") + 1)

    text = pick(WORDINGS, order)
    year = F.lit(FIRST_YEAR) + order % 23
    for slot, value in {
        "{h}": pick(HAZARDS, customer),
        "{y}": year.cast("string"),
        "{z}": (year + customer % 9).cast("string"),
        "{c}": pick(PLACES, order + customer),
        "{s}": F.initcap(pick(STATE_NAMES, order * 7 + customer)),
        "{a}": pick(tuple(words.STATES.values()), customer + 3),
        "{n}": (customer % 40 + 1).cast("string"),
        "{f}": (customer % 89999 + 10001).cast("string"),
    }.items():
        text = F.replace(text, F.lit(slot), value)
    asked = spread(orders).select(
        F.concat(F.lit("o"), order.cast("string")).alias("question_id"), text.alias("question")
    )
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    said = turns.select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id"), F.col("turn")).alias("question_id"),
        F.col("text").alias("question"),
    )
    return asked.unionByName(said)


def _years(spark, sf_dir):
    return questions.extract_years(question_log(spark, sf_dir)).drop("question")


def _limit(spark, sf_dir):
    return questions.extract_limit(question_log(spark, sf_dir)).drop("question")


def _category(spark, sf_dir):
    return questions.extract_category(question_log(spark, sf_dir)).drop("question")


def _group(spark, sf_dir):
    return questions.extract_group(question_log(spark, sf_dir)).drop("question")


def _entity(spark, sf_dir):
    rows = questions.extract_entities(
        questions.extract_entity(question_log(spark, sf_dir))
    )
    return rows.select("question_id", "entity", F.array_join("entities", "|").alias("entities"))


def _periods(spark, sf_dir):
    years = questions.extract_years(question_log(spark, sf_dir))
    return questions.period_split(years).drop("question", "start_year", "end_year")


def _template(spark, sf_dir):
    return questions.tag_template(question_log(spark, sf_dir)).drop("question")


def _route(spark, sf_dir):
    rows = questions.route_questions(question_log(spark, sf_dir))
    return rows.select("question_id", F.array_join("tools", "+").alias("tools"), "is_hybrid")


def _distribution(spark, sf_dir):
    return questions.routing_distribution(
        questions.route_questions(question_log(spark, sf_dir))
    )


def _screen(spark, sf_dir):
    return questions.screen_questions(question_log(spark, sf_dir)).drop("question")


def _coverage(spark, sf_dir):
    rows = questions.coverage_flags(question_log(spark, sf_dir))
    return rows.select(
        "question_id", F.array_join("years_outside", ",").alias("years_outside"), "is_outside"
    )


def _notes(spark, sf_dir):
    """Result sizes and zero flags are invented from the length of the question."""
    tagged = questions.tag_template(question_log(spark, sf_dir)).withColumns(
        {
            "row_count": F.length("question") % 11,
            "all_zero": F.length("question") % 3 == 0,
        }
    )
    return questions.quality_notes(tagged).select("question_id", "template", "note")


# What a report is asked with where the log names no more than the report.
REQUESTS = {
    "top_entities_by_score": {"start_year": gold.FIRST, "end_year": gold.LAST},
    "top_entities_in_group": {"start_year": 1996, "end_year": 2000, "group": "nowhere"},
    "group_totals": {"start_year": gold.FIRST, "end_year": gold.LAST, "limit": 25},
    "yearly_trend": {"start_year": gold.FIRST, "end_year": gold.LAST},
    "category_trend": {"start_year": gold.FIRST, "end_year": gold.LAST, "category": "STANDARD"},
}


def _report_notes(spark, sf_dir):
    """Notes of the log from reports that were run: their sizes and zero flags are observed."""
    facts = gold.gold(spark, sf_dir).facts(REQUESTS)
    tagged = questions.tag_template(question_log(spark, sf_dir)).join(
        F.broadcast(facts), "template", "left")
    return questions.quality_notes(tagged).select("question_id", "template", "row_count", "note")


QUERIES = {
    "report_notes": _report_notes,
    "extract_years": _years,
    "extract_limit": _limit,
    "extract_category": _category,
    "extract_group": _group,
    "extract_entity": _entity,
    "period_split": _periods,
    "tag_template": _template,
    "route_questions": _route,
    "routing_distribution": _distribution,
    "screen_questions": _screen,
    "coverage_flags": _coverage,
    "quality_notes": _notes,
}


# -- SQL ----------------------------------------------------------------------------------


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick_sql(values, index: str) -> str:
    return (
        f"list_extract([{', '.join(map(_quote, values))}], "
        f"CAST(({index}) % {len(values)} AS INTEGER) + 1)"
    )


def _title(name: str) -> str:
    return " ".join(part.capitalize() for part in name.split(" "))


def _log_sql() -> str:
    text = _pick_sql(WORDINGS, "o_orderkey")
    slots = {
        "{h}": _pick_sql(HAZARDS, "o_custkey"),
        "{y}": f"CAST({FIRST_YEAR} + o_orderkey % 23 AS VARCHAR)",
        "{z}": f"CAST({FIRST_YEAR} + o_orderkey % 23 + o_custkey % 9 AS VARCHAR)",
        "{c}": _pick_sql(PLACES, "o_orderkey + o_custkey"),
        "{s}": _pick_sql([_title(s) for s in STATE_NAMES], "o_orderkey * 7 + o_custkey"),
        "{a}": _pick_sql(tuple(words.STATES.values()), "o_custkey + 3"),
        "{n}": "CAST(o_custkey % 40 + 1 AS VARCHAR)",
        "{f}": "CAST(o_custkey % 89999 + 10001 AS VARCHAR)",
    }
    for slot, value in slots.items():
        text = f"replace({text}, '{slot}', {value})"
    return f"""log AS (SELECT 'o' || o_orderkey AS question_id, {text} AS question FROM orders
UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user'),
q AS (SELECT *, lower(question) AS low FROM log)"""


LOG = _log_sql()


def _has(pattern: str, column: str = "low") -> str:
    return f"regexp_matches({column}, {_quote(pattern)})"


def _any(patterns, column: str = "low") -> str:
    return "(" + " OR ".join(_has(p, column) for p in patterns) + ")"


def _contains(phrases) -> str:
    return "(" + " OR ".join(f"contains(low, {_quote(p)})" for p in phrases) + ")"


_YEARS_SQL = f"""years AS (SELECT *, list_transform(
  regexp_extract_all(question, {_quote(words.YEAR_20XX)}, 1), lambda y: CAST(y AS INTEGER)) AS ys
  FROM q),
ranged AS (SELECT *,
  CASE WHEN len(ys) > 0 THEN list_min(ys) ELSE {words.FIRST_YEAR} END AS start_year,
  CASE WHEN len(ys) >= 2 THEN list_max(ys)
    WHEN len(ys) = 1 THEN greatest(ys[1], {words.LAST_YEAR})
    ELSE {words.LAST_YEAR} END AS end_year FROM years)"""

_LIMIT_SQL = f"""CAST(COALESCE(
  TRY_CAST(CASE WHEN regexp_extract(question, {_quote(words.LIMIT)}, 1) <> ''
      THEN regexp_extract(question, {_quote(words.LIMIT)}, 1)
    WHEN regexp_extract(question, {_quote(words.LIMIT)}, 2) <> ''
      THEN regexp_extract(question, {_quote(words.LIMIT)}, 2) END AS INTEGER),
  CASE WHEN {_has(words.SINGULAR, "question")} AND NOT {_has(words.PLURAL, "question")}
    AND {_has(words.SUPERLATIVE, "question")} THEN 1 ELSE 10 END) AS INTEGER)"""

_CATEGORY_SQL = (
    "CASE "
    + " ".join(
        f"WHEN contains(low, {_quote(p)}) THEN {_quote(c)}"
        for p, c in longest_first(words.CATEGORY_PHRASES).items()
    )
    + " ELSE 'all' END"
)

_STATE_SQL = (
    "CASE "
    + " ".join(
        f"WHEN {_has(chr(92) + 'b' + s + chr(92) + 'b')} THEN {_quote(s)}"
        for s in longest_first(words.STATES)
    )
    + " END"
)

_GROUP_SQL = (
    "CASE "
    + " ".join(
        f"WHEN {_has(chr(92) + 'b' + s + chr(92) + 'b')} THEN {_quote(_title(s))}"
        for s in longest_first(words.STATES)
    )
    + " "
    + " ".join(
        f"WHEN regexp_extract(question, {_quote(words.STATE_CODE)}, 1) = '{a}' "
        f"THEN {_quote(_title(s))}"
        for s, a in words.STATES.items()
    )
    + " ELSE '' END"
)

_MIDDLE = "CAST(floor((start_year + end_year) / 2.0) AS INTEGER)"

_REPORT_SQL = (
    "CASE "
    + " ".join(f"WHEN {_has(p)} THEN '{n}'" for n, p in words.REPORT_PATTERNS)
    + f" ELSE '{words.DEFAULT_REPORT}' END"
)
_TRACKED = ", ".join(_quote(c) for c in words.TRACKED_CATEGORIES)

_TAGGED = f"""{LOG}, {_YEARS_SQL},
first_tags AS (SELECT *, {_LIMIT_SQL} AS row_limit, {_CATEGORY_SQL} AS category,
  {_REPORT_SQL} AS report, {_STATE_SQL} AS state, {_has(words.GROUP_SCOPE)} AS scoped,
  {_MIDDLE} AS middle FROM ranged),
tagged AS (SELECT *, CASE
  WHEN report = 'largest_increase' AND category <> 'all' THEN 'category_increase'
  WHEN report = 'top_entities_by_score' AND category <> 'all' THEN 'top_entities_by_category'
  WHEN report = 'yearly_trend' AND category IN ({_TRACKED}) THEN 'category_trend'
  WHEN report = 'yearly_trend' AND category <> 'all' THEN 'category_trend_specific'
  WHEN report = 'top_entities_by_score' AND state IS NOT NULL AND scoped
    THEN 'top_entities_in_group'
  ELSE report END AS template FROM first_tags)"""

_ROUTED = f"""{LOG}, signals AS (SELECT *, {_any(words.PREDICT_SIGNALS)} AS p,
  {_any(words.QUERY_SIGNALS)} AS r, {_any(words.ASK_SIGNALS)} AS a,
  {_has(words.FIPS, "question")} OR {_has(words.COUNTY_NAME, "question")} AS c FROM q),
routed AS (SELECT question_id, CASE WHEN p AND r AND c THEN 'predict+query'
  WHEN p AND r THEN 'query' WHEN r AND a THEN 'query+ask' WHEN p THEN 'predict'
  WHEN r THEN 'query' ELSE 'ask' END AS tools FROM signals)"""

_OUTSIDE = f"""list_sort(list_distinct(list_filter(list_transform(
  regexp_extract_all(question, {_quote(words.YEAR_ANY)}, 1), lambda y: CAST(y AS INTEGER)),
  lambda y: y < {words.FIRST_YEAR} OR y > {words.LAST_YEAR})))"""


def _in(names) -> str:
    return "template IN (" + ", ".join(_quote(n) for n in names) + ")"


_INCREASE = "template IN ('largest_increase', 'category_increase')"

_REPORTED = {
    "top_entities_by_score": (gold.ORACLES["top_entities_by_score"], "0"),
    "group_totals": (gold.ORACLES["group_totals"], "0"),
    "yearly_trend": (gold.ORACLES["yearly_trend"], "total_events"),
    "category_trend": (gold.ORACLES["category_trend"], "total_events"),
}
_FACTS = " UNION ALL ".join(
    f"SELECT '{name}' AS template, CAST(COUNT(*) AS INTEGER) AS row_count, "
    f"{'FALSE' if metric == '0' else f'BOOL_AND({metric} = 0)'} AS all_zero FROM ({sql}) t"
    for name, (sql, metric) in _REPORTED.items()
) + " UNION ALL SELECT 'top_entities_in_group', 0, FALSE"

ORACLES = {
    "report_notes": f"""WITH {_TAGGED}, facts AS ({_FACTS})
SELECT question_id, q.template, row_count, CASE
  WHEN len({_OUTSIDE}) > 0 THEN 'years'
  WHEN row_count = 0 THEN ''
  WHEN category <> 'all' AND NOT q.{_in(words.CATEGORY_REPORTS)} THEN 'not_filtered'
  WHEN category = 'Tropical Storm' AND q.{_in(words.STORM_REPORTS)} THEN 'storm_record'
  WHEN category = 'Wildfire' AND q.{_in(words.FIRE_REPORTS)} THEN 'fire_record'
  WHEN category <> 'all' AND q.template = 'top_entities_by_category'
    AND {_contains(words.RISK_WORDS)} THEN 'frequency'
  WHEN all_zero THEN 'all_zero' ELSE '' END AS note
FROM tagged q LEFT JOIN facts ON q.template = facts.template""",
    "extract_years": f"WITH {LOG}, {_YEARS_SQL} "
    "SELECT question_id, start_year, end_year FROM ranged",
    "extract_limit": f"WITH {LOG} SELECT question_id, {_LIMIT_SQL} AS row_limit FROM q",
    "extract_category": f"WITH {LOG} SELECT question_id, {_CATEGORY_SQL} AS category FROM q",
    "extract_group": f"WITH {LOG} SELECT question_id, {_GROUP_SQL} AS group_name FROM q",
    "extract_entity": f"""WITH {LOG},
found AS (SELECT question_id, regexp_extract(question, {_quote(words.FIPS)}, 1) AS code,
  trim(regexp_extract(question, {_quote(words.COUNTY_NAME)}, 1)) AS name,
  list_concat(regexp_extract_all(question, {_quote(words.FIPS)}, 1),
    list_transform(regexp_extract_all(question, {_quote(words.COUNTY_NAME)}, 1),
      lambda n: trim(n))) AS everything FROM q)
SELECT question_id, CASE WHEN code <> '' THEN code WHEN name <> '' THEN name END AS entity,
  COALESCE(array_to_string(list_transform(list_filter(everything,
    lambda x, i: list_position(everything, x) = i), lambda x: x), '|'), '') AS entities
FROM found""",
    "period_split": f"""WITH {LOG}, {_YEARS_SQL}
SELECT question_id, start_year AS period_a_start, {_MIDDLE} AS period_a_end,
  {_MIDDLE} + 1 AS period_b_start, end_year AS period_b_end FROM ranged""",
    "tag_template": f"""WITH {_TAGGED}
SELECT question_id, start_year, end_year, row_limit, category, template,
  CASE WHEN {_INCREASE} THEN start_year END AS period_a_start,
  CASE WHEN {_INCREASE} THEN middle END AS period_a_end,
  CASE WHEN {_INCREASE} THEN middle + 1 END AS period_b_start,
  CASE WHEN {_INCREASE} THEN end_year END AS period_b_end,
  CASE WHEN template = 'top_entities_by_category' THEN
    CASE WHEN {_contains(words.SEVERE_WORDS)} THEN 'total_severe'
      WHEN {_contains(words.MINOR_WORDS)} THEN 'total_minor' ELSE 'total_events' END END
    AS order_col,
  CASE WHEN template = 'top_entities_in_group' THEN state END AS group_name
FROM tagged""",
    "route_questions": f"""WITH {_ROUTED}
SELECT question_id, tools, contains(tools, '+') AS is_hybrid FROM routed""",
    "routing_distribution": f"""WITH {_ROUTED}
SELECT tools, COUNT(*) AS questions,
  CAST(SUM(CASE WHEN contains(tools, '+') THEN 1 ELSE 0 END) AS BIGINT) AS hybrid
FROM routed GROUP BY tools""",
    "screen_questions": f"""WITH {LOG} SELECT question_id,
  {_any(words.INJECTION_PATTERNS, "question")} AS is_injection FROM q""",
    "coverage_flags": f"""WITH {LOG}
SELECT question_id, COALESCE(array_to_string({_OUTSIDE}, ','), '') AS years_outside,
  len({_OUTSIDE}) > 0 AS is_outside FROM q""",
    "quality_notes": f"""WITH {_TAGGED}
SELECT question_id, template, CASE
  WHEN len({_OUTSIDE}) > 0 THEN 'years'
  WHEN length(question) % 11 = 0 THEN ''
  WHEN category <> 'all' AND NOT {_in(words.CATEGORY_REPORTS)} THEN 'not_filtered'
  WHEN category = 'Tropical Storm' AND {_in(words.STORM_REPORTS)} THEN 'storm_record'
  WHEN category = 'Wildfire' AND {_in(words.FIRE_REPORTS)} THEN 'fire_record'
  WHEN category <> 'all' AND template = 'top_entities_by_category'
    AND {_contains(words.RISK_WORDS)} THEN 'frequency'
  WHEN length(question) % 3 = 0 THEN 'all_zero' ELSE '' END AS note
FROM tagged""",
}
