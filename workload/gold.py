"""Gold tables derived from the supplied ones, and the reports over them.

Entities are suppliers, groups are nations, categories are part types and events are
line items.  The SQL beside each query spells out the same rows for another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.numeric import cents, rounded
from tallygrid.operators import ranking, resolve, trends
from tallygrid.operators.questions import all_zero_checks
from tallygrid.plans.governed import Gold
from tallygrid.schemas import Names
from tallygrid.sources.readers import union_parts

FIRST, LAST = 1995, 2001
EARLY, LATE = (1995, 1997), (1998, 2001)
NAMES = Names()


# Column types of the supplied files; declared, so that no scan starts with a footer job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def in_ship_years(df: DataFrame, first: int, last: int) -> DataFrame:
    """A range on the raw timestamp, which the Parquet reader can use to skip row groups."""
    shipped = F.col("l_shipdate")
    return df.filter(
        (shipped >= F.lit(f"{first}-01-01").cast("timestamp_ntz"))
        & (shipped < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz"))
    )


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("entity_id"),
            F.col("s_name").alias("entity_name"),
            F.col("n_name").alias("group_name"),
            F.col("r_name").alias("region_name"),
        )
    )


def _money(flag: Column, value: Column) -> Column:
    """Sum of whole cents where ``flag`` holds.

    A line is below 1e7 cents, so sums stay inside a bigint up to 9e11 lines.
    """
    return F.sum(F.when(flag, cents(value)).otherwise(0)).cast("double") / 100.0


def _per_event(total_cents: Column) -> Column:
    mean = total_cents.cast("double") / F.count("*").cast("double")
    return rounded(mean, 4).cast("decimal(18,4)")


def mart(
    spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Entity x year.  Columns a query does not use are pruned from scan and aggregate.

    Orders are told apart on the three columns they need, so that a line's sums never travel by
    order; a query that does not use their number reads the lines once, without the join.
    """
    lines = table(spark, sf_dir, "lineitem")
    if first is not None:
        lines = in_ship_years(lines, first, last)
    price, status, line = F.col("l_extendedprice"), F.col("l_linestatus"), F.col("l_linenumber")
    returned, accepted = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    every = F.lit(True)
    # As one struct a key without an entity or a year meets its like, and is known to be unique.
    place = F.struct(F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").alias("year"))
    declared = lines.select(place.alias("_place"), "l_orderkey").distinct().groupBy("_place").agg(
        F.count("l_orderkey").alias("declaration_count"))
    rolled = lines.groupBy(place.alias("_place")).agg(
        F.count("*").alias("event_count"),
        F.count_if(returned).alias("severe_count"),
        F.count_if(accepted).alias("minor_count"),
        _money(every, price * (1 - F.col("l_discount"))).alias("total_damage"),
        F.when(F.count_if(returned) > 0, rounded(_money(every, price) / F.count("*"), 2))
        .cast("decimal(18,2)")
        .alias("avg_damage"),
        _per_event(F.sum(cents(F.col("l_quantity")))).alias("loss_score"),
        _per_event(F.sum(cents(F.col("l_tax")))).alias("risk_score"),
        _per_event(F.sum(cents(F.col("l_discount")))).alias("vulnerability_score"),
        _per_event(F.count_if(accepted) * 100).alias("resilience_score"),
        F.count_if(line == 1).alias("registrations"),
        _money(every, price * F.col("l_tax")).alias("approved_amount"),
        _money(returned, price).alias("repair_amount"),
        _money(accepted, price).alias("rental_amount"),
        _money(~returned & ~accepted, price).alias("other_amount"),
        F.count_if(status == "F").alias("inspected"),
        _money(every, F.col("l_quantity")).alias("population_total"),
        F.max("l_extendedprice").alias("home_value"),
        F.count_if(status == "O").alias("labor_force"),
        F.count_if(returned & (status == "O")).alias("unemployed"),
        F.count_if(line <= 2).alias("bachelors"),
    )
    sums = [c for c in rolled.columns if c != "_place"]
    return rolled.join(declared, "_place", "left").select(
        "_place.*", *sums[:3], "declaration_count", *sums[3:])


def events(
    spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Entity x category x year."""
    lines = table(spark, sf_dir, "lineitem")
    if first is not None:
        lines = in_ship_years(lines, first, last)
    returned = F.col("l_returnflag") == "R"
    price = _money(F.lit(True), F.col("l_extendedprice"))
    return (
        lines.join(
            table(spark, sf_dir, "part").select("p_partkey", "p_type"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .groupBy(
            F.col("l_suppkey").alias("entity_id"),
            F.col("p_type").alias("category"),
            F.year("l_shipdate").alias("year"),
        )
        .agg(
            F.count("*").alias("event_count"),
            F.count_if(returned).alias("severe_count"),
            F.count_if(F.col("l_returnflag") == "A").alias("minor_count"),
            F.when(F.count_if(returned) > 0, rounded(price / F.count("*"), 2))
            .cast("decimal(18,2)")
            .alias("avg_damage"),
        )
    )


def gold(spark: SparkSession, sf_dir: str) -> Gold:
    return Gold(
        mart(spark, sf_dir, FIRST, LAST),
        events(spark, sf_dir, FIRST, LAST),
        entity(spark, sf_dir),
        names=NAMES,
        combined=(("ECONOMY", "SMALL"),),
        min_year=1990,
        max_year=2010,
        id_pattern=re.compile(r"[0-9]+"),
    )


# -- the same tables as SQL ---------------------------------------------------------------

ENTITY = """g_entity AS (
  SELECT s_suppkey AS entity_id, s_name AS entity_name, n_name AS group_name,
         r_name AS region_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def _cents(value: str) -> str:
    return f"CAST(floor(({value}) * 100.0 + 0.5) AS BIGINT)"


def _sql_money(value: str, flag: str = "TRUE") -> str:
    return f"CAST(SUM(CASE WHEN {flag} THEN {_cents(value)} ELSE 0 END) AS DOUBLE) / 100.0"


def _sql_score(total: str) -> str:
    return (
        f"CAST(ROUND(CAST({total} AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 4) AS DECIMAL(18,4))"
    )


_R, _A = "l_returnflag = 'R'", "l_returnflag = 'A'"


def _count(flag: str) -> str:
    return f"SUM(CASE WHEN {flag} THEN 1 ELSE 0 END)"


MART = f"""g_mart AS (
  SELECT l_suppkey AS entity_id, CAST(year(l_shipdate) AS INTEGER) AS year,
    COUNT(*) AS event_count, {_count(_R)} AS severe_count, {_count(_A)} AS minor_count,
    COUNT(DISTINCT l_orderkey) AS declaration_count,
    {_sql_money("l_extendedprice * (1 - l_discount)")} AS total_damage,
    CASE WHEN {_count(_R)} > 0 THEN
      CAST(ROUND(({_sql_money("l_extendedprice")}) / COUNT(*), 2) AS DECIMAL(18,2)) END
      AS avg_damage,
    {_sql_score(f"SUM({_cents('l_quantity')})")} AS loss_score,
    {_sql_score(f"SUM({_cents('l_tax')})")} AS risk_score,
    {_sql_score(f"SUM({_cents('l_discount')})")} AS vulnerability_score,
    {_sql_score(f"({_count(_A)} * 100)")} AS resilience_score,
    {_count("l_linenumber = 1")} AS registrations,
    {_sql_money("l_extendedprice * l_tax")} AS approved_amount,
    {_sql_money("l_extendedprice", _R)} AS repair_amount,
    {_sql_money("l_extendedprice", _A)} AS rental_amount,
    {_sql_money("l_extendedprice", "l_returnflag NOT IN ('R', 'A')")} AS other_amount,
    {_count("l_linestatus = 'F'")} AS inspected,
    {_sql_money("l_quantity")} AS population_total,
    MAX(l_extendedprice) AS home_value,
    {_count("l_linestatus = 'O'")} AS labor_force,
    {_count(_R + " AND l_linestatus = 'O'")} AS unemployed,
    {_count("l_linenumber <= 2")} AS bachelors
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate))"""

EVENT = f"""g_event AS (
  SELECT l_suppkey AS entity_id, p_type AS category, CAST(year(l_shipdate) AS INTEGER) AS year,
    COUNT(*) AS event_count, {_count(_R)} AS severe_count, {_count(_A)} AS minor_count,
    CASE WHEN {_count(_R)} > 0 THEN
      CAST(ROUND(({_sql_money("l_extendedprice")}) / COUNT(*), 2) AS DECIMAL(18,2)) END
      AS avg_damage
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY l_suppkey, p_type, year(l_shipdate))"""


def mean(column: str) -> str:
    return f"CAST(SUM({column}) AS DOUBLE) / COUNT({column})"


def big(column: str, alias: str | None = None) -> str:
    return f"CAST({column} AS BIGINT) AS {alias or column}"


def _score_sql(places: int, where: str, limit: int) -> str:
    return f"""WITH {ENTITY}, {MART}
SELECT m.entity_id, entity_name, group_name,
  ROUND({mean("loss_score")}, {places}) AS avg_loss_score,
  ROUND({mean("risk_score")}, 4) AS avg_risk_score,
  ROUND({mean("vulnerability_score")}, 4) AS avg_vulnerability,
  ROUND({mean("resilience_score")}, 4) AS avg_resilience,
  COUNT(*) AS years_on_record
FROM g_mart m JOIN g_entity e ON m.entity_id = e.entity_id
WHERE {where} GROUP BY m.entity_id, entity_name, group_name
ORDER BY avg_loss_score DESC NULLS LAST, m.entity_id LIMIT {limit}"""


def _top_by_score(spark, sf_dir):
    return gold(spark, sf_dir).run(
        "top_entities_by_score", start_year=FIRST, end_year=LAST, limit=20
    )


def _top_in_group(spark, sf_dir):
    # Group names of this data hold a digit, which a governed text parameter rejects.
    return ranking.top_entities_in_group(
        mart(spark, sf_dir, 1996, 2000), entity(spark, sf_dir), "NATION_7", 1996, 2000, 20
    )


def _comparison(spark, sf_dir):
    return gold(spark, sf_dir).run(
        "entity_comparison", ids=["3", "11", "12"], start_year=1996, end_year=2000
    )


def _group_totals(spark, sf_dir):
    return gold(spark, sf_dir).run("group_totals", start_year=FIRST, end_year=LAST, limit=25)


def _yearly_trend(spark, sf_dir):
    return gold(spark, sf_dir).run("yearly_trend", start_year=FIRST, end_year=LAST)


def _periods():
    return {
        "period_a_start": EARLY[0], "period_a_end": EARLY[1],
        "period_b_start": LATE[0], "period_b_end": LATE[1],
    }


def _largest_increase(spark, sf_dir):
    return gold(spark, sf_dir).run("largest_increase", limit=20, **_periods())


def _category_increase(spark, sf_dir):
    return gold(spark, sf_dir).run(
        "category_increase", category="PROMO", limit=50, **_periods()
    )


def _top_by_category(spark, sf_dir):
    return gold(spark, sf_dir).run(
        "top_entities_by_category", category="MEDIUM", order_col="total_events",
        start_year=FIRST, end_year=LAST,
    )


def _top_combined(spark, sf_dir):
    return gold(spark, sf_dir).run(
        "top_entities_by_category", category="SMALL", order_col="total_events",
        start_year=FIRST, end_year=LAST, limit=40,
    )


def _top_merged(spark, sf_dir):
    return ranking.top_entities_by_category(
        events(spark, sf_dir), entity(spark, sf_dir), ["ECONOMY", "SMALL"], FIRST, LAST,
        "total_severe", 40, merge_combined=True,
    )


def _top_nonzero(spark, sf_dir):
    """Severe means nine or more returned lines in a year here, so zeros do occur."""
    rare = events(spark, sf_dir).withColumn(
        "severe_count", F.when(F.col("severe_count") >= 9, F.col("severe_count")).otherwise(0)
    )
    return ranking.top_entities_by_category(
        rare, entity(spark, sf_dir), "LARGE", FIRST, LAST, "total_severe", 100, nonzero=True
    )


def _category_trend(spark, sf_dir):
    return gold(spark, sf_dir).run(
        "category_trend", category="STANDARD", start_year=FIRST, end_year=LAST
    )


def _snapshot(spark, sf_dir):
    rows = ranking.latest_snapshot(mart(spark, sf_dir))
    return rows.select(
        "entity_id", "year", "event_count", "declaration_count",
        F.col("loss_score").cast("double").alias("loss_score"),
    )


def _entity_rank(spark, sf_dir):
    # Ranked over all entities; a limit for display would come after.
    report = trends.largest_increase(
        mart(spark, sf_dir), entity(spark, sf_dir), EARLY, LATE, limit=None
    ).withColumn("absolute_increase", F.floor(F.col("absolute_increase")))
    return ranking.entity_rank(report, "absolute_increase").select(
        "entity_id", "absolute_increase", "rank"
    )


def _labels(spark, sf_dir):
    return ranking.entity_labels(entity(spark, sf_dir)).select("entity_id", "label")


def _semi(spark, sf_dir):
    """Events of the entities of one region, rolled up."""
    chosen = entity(spark, sf_dir).filter(F.col("region_name").isin("ASIA", "EUROPE"))
    rows = trends.semi_events(events(spark, sf_dir), chosen)
    return rows.groupBy("category", "year").agg(
        F.sum("event_count").alias("total_events"),
        F.countDistinct("entity_id").alias("entities"),
    )


def _all_zero(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("zero_count", F.lit("0"))
    return all_zero_checks(rows, {
        "zero_count": ["zero_count", "absent"],
        "zero_count,severe_count": ["zero_count", "severe_count"],
    })


def _union_parts(spark, sf_dir):
    """Orders split by status, column order shuffled, and united again."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    parts = [
        orders.filter(F.col("o_orderstatus") == "F"),
        orders.filter(F.col("o_orderstatus") == "O").select(
            "o_custkey", "o_orderkey", "o_orderstatus"
        ),
        orders.filter(~F.col("o_orderstatus").isin("F", "O")),
    ]
    return union_parts(parts)


PART_NAMES = Names(entity="p_partkey", name="p_name", group="p_brand")


def _lookups(spark, sf_dir):
    """Names to resolve, made from every part: exact, hyphenated, cut, some with a brand."""
    name = F.col("p_name")
    spelled = (
        F.when(F.col("p_size") % 3 == 0, F.upper(name))
        .when(F.col("p_size") % 3 == 1, F.replace(name, F.lit(" "), F.lit("-")))
        .otherwise(F.substring(name, F.lit(1), F.length(name) - 2))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("lookup_id"),
        spelled.alias("name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("hint"),
    )


def _resolve(spark, sf_dir):
    found = resolve.resolve_entity(
        _lookups(spark, sf_dir), table(spark, sf_dir, "part"), hint="hint", names=PART_NAMES
    )
    return found.select("lookup_id", "p_partkey", "p_name", "p_brand", "priority")


def _ambiguous(spark, sf_dir):
    found = resolve.ambiguous_names(table(spark, sf_dir, "part"), names=PART_NAMES)
    return found.select(
        "name", "group_count", F.array_join("groups", ",").alias("groups")
    )


def _period_sql(table_name: str, how: str, where: str) -> str:
    def side(alias: str, years: tuple[int, int]) -> str:
        return (
            f"{alias} AS (SELECT entity_id, {how} AS x FROM {table_name} "
            f"WHERE year BETWEEN {years[0]} AND {years[1]}{where} GROUP BY entity_id)"
        )

    return side("period_a", EARLY) + ", " + side("period_b", LATE)


_TOP_CATEGORY = """SELECT h.entity_id, entity_name, group_name, {category} AS category,
  CAST(SUM(event_count) AS BIGINT) AS total_events,
  CAST(SUM({severe}) AS BIGINT) AS total_severe,
  CAST(SUM(minor_count) AS BIGINT) AS total_minor,
  COUNT(DISTINCT year) AS years_with_events
FROM g_event h JOIN g_entity e ON h.entity_id = e.entity_id
WHERE h.category IN ({wanted}) AND year BETWEEN {first} AND {last}
GROUP BY h.entity_id, entity_name, group_name{by}
ORDER BY {order} DESC, h.entity_id, 4 LIMIT {limit}"""


def _top_category_sql(
    wanted, order="total_events", limit=20, merged=False, severe="severe_count"
) -> str:
    quoted = ", ".join(f"'{w}'" for w in wanted)
    body = _TOP_CATEGORY.format(
        category=f"'{'/'.join(wanted)}'" if merged else "h.category",
        severe=severe, wanted=quoted, first=FIRST, last=LAST,
        by="" if merged else ", h.category", order=order, limit=limit,
    )
    return f"WITH {ENTITY}, {EVENT}\n{body}"


_INCREASE_SQL = f"""WITH {ENTITY}, {MART}, {_period_sql("g_mart", mean("event_count"), "")}
SELECT a.entity_id, entity_name, group_name,
  ROUND(a.x, 2) AS avg_events_early, ROUND(b.x, 2) AS avg_events_recent,
  ROUND(b.x - a.x, 2) AS absolute_increase,
  ROUND(100.0 * (b.x - a.x) / a.x, 2) AS pct_increase
FROM period_a a JOIN period_b b ON a.entity_id = b.entity_id
JOIN g_entity e ON a.entity_id = e.entity_id
ORDER BY absolute_increase DESC, a.entity_id"""

# One text for both engines: table expressions, a window, a join and a subquery.
FREE_SQL = """WITH yearly AS (
  SELECT entity_id, year, SUM(event_count) AS n, SUM(severe_count) AS severe
  FROM gold.events WHERE category <> 'ECONOMY' GROUP BY entity_id, year),
placed AS (
  SELECT *, RANK() OVER (PARTITION BY year ORDER BY n DESC, entity_id) AS place FROM yearly)
SELECT p.year, CAST(p.place AS INT) AS place, e.entity_name, e.group_name,
  CAST(p.n AS BIGINT) AS total_events, CAST(m.severe_count AS BIGINT) AS severe_of_year
FROM placed p JOIN entity e ON p.entity_id = e.entity_id
JOIN gold.mart m ON m.entity_id = p.entity_id AND m.year = p.year
WHERE p.place <= 9 AND e.region_name IN (
  SELECT region_name FROM entity GROUP BY region_name HAVING COUNT(*) > 1)
ORDER BY p.year, p.place"""


def _gold_sql(spark, sf_dir):
    """A free query over the gold tables, through the guard."""
    gold = Gold(mart(spark, sf_dir), events(spark, sf_dir), entity(spark, sf_dir), NAMES)
    return gold.sql(FREE_SQL, database="gold")


QUERIES = {
    "gold_sql": _gold_sql,
    "top_entities_by_score": _top_by_score,
    "top_entities_in_group": _top_in_group,
    "entity_comparison": _comparison,
    "group_totals": _group_totals,
    "yearly_trend": _yearly_trend,
    "largest_increase": _largest_increase,
    "category_increase": _category_increase,
    "top_entities_by_category": _top_by_category,
    "top_entities_combined_category": _top_combined,
    "top_entities_merged_category": _top_merged,
    "top_entities_nonzero": _top_nonzero,
    "category_trend": _category_trend,
    "latest_snapshot": _snapshot,
    "entity_rank": _entity_rank,
    "entity_labels": _labels,
    "semi_events": _semi,
    "all_zero_check": _all_zero,
    "union_parts": _union_parts,
    "resolve_entity": _resolve,
    "ambiguous_names": _ambiguous,
}

ORACLES = {
    "gold_sql": f"""WITH {ENTITY}, {MART}, {EVENT},
mart AS (SELECT * FROM g_mart), events AS (SELECT * FROM g_event),
entity AS (SELECT * FROM g_entity)
SELECT * FROM ({FREE_SQL.replace("gold.", "")}) t LIMIT 100""",
    "top_entities_by_score": _score_sql(2, f"year BETWEEN {FIRST} AND {LAST}", 20),
    "top_entities_in_group": _score_sql(
        4, "year BETWEEN 1996 AND 2000 AND LOWER(group_name) = 'nation_7'", 20
    ),
    "entity_comparison": f"""WITH {ENTITY}, {MART}
SELECT m.entity_id, entity_name, group_name, year, event_count, {big("severe_count")},
  declaration_count, ROUND(total_damage, 2) AS total_damage,
  ROUND(CAST(loss_score AS DOUBLE), 2) AS loss_score,
  ROUND(CAST(risk_score AS DOUBLE), 4) AS risk_score,
  ROUND(CAST(vulnerability_score AS DOUBLE), 4) AS vulnerability,
  ROUND(CAST(resilience_score AS DOUBLE), 4) AS resilience
FROM g_mart m JOIN g_entity e ON m.entity_id = e.entity_id
WHERE m.entity_id IN (3, 11, 12) AND year BETWEEN 1996 AND 2000
ORDER BY m.entity_id, year LIMIT 100""",
    "group_totals": f"""WITH {ENTITY}, {MART}
SELECT group_name, {big("SUM(declaration_count)", "total_declarations")},
  COUNT(DISTINCT m.entity_id) AS entities_affected,
  CAST(SUM(declaration_count) AS DOUBLE) / NULLIF(COUNT(DISTINCT m.entity_id), 0)
    AS avg_declarations_per_entity,
  ROUND(SUM(total_damage), 2) AS total_damage
FROM g_mart m JOIN g_entity e ON m.entity_id = e.entity_id
WHERE year BETWEEN {FIRST} AND {LAST}
GROUP BY group_name ORDER BY total_declarations DESC, group_name LIMIT 25""",
    "yearly_trend": f"""WITH {MART}
SELECT year, COUNT(DISTINCT entity_id) AS entities_affected,
  {big("SUM(event_count)", "total_events")}, {big("SUM(severe_count)", "total_severe")},
  ROUND({mean("avg_damage")}, 2) AS avg_damage,
  {big("SUM(declaration_count)", "total_declarations")},
  ROUND({mean("loss_score")}, 2) AS avg_loss_score
FROM g_mart WHERE year BETWEEN {FIRST} AND {LAST} GROUP BY year ORDER BY year LIMIT 100""",
    "largest_increase": _INCREASE_SQL + " LIMIT 20",
    "category_increase": f"""WITH {ENTITY}, {EVENT},
{_period_sql("g_event", "CAST(SUM(event_count) AS BIGINT)", " AND category = 'PROMO'")}
SELECT a.entity_id, entity_name, group_name, a.x AS events_early_period,
  b.x AS events_recent_period, b.x - a.x AS absolute_increase,
  ROUND(100.0 * (b.x - a.x) / CAST(a.x AS DOUBLE), 2) AS pct_increase
FROM period_a a JOIN period_b b ON a.entity_id = b.entity_id
JOIN g_entity e ON a.entity_id = e.entity_id
WHERE b.x - a.x > 0 ORDER BY absolute_increase DESC, a.entity_id LIMIT 50""",
    "top_entities_by_category": _top_category_sql(["MEDIUM"]),
    "top_entities_combined_category": _top_category_sql(["ECONOMY", "SMALL"], limit=40),
    "top_entities_merged_category": _top_category_sql(
        ["ECONOMY", "SMALL"], "total_severe", 40, merged=True
    ),
    "top_entities_nonzero": "SELECT * FROM ("
    + _top_category_sql(
        ["LARGE"], "total_severe", 100,
        severe="CASE WHEN severe_count >= 9 THEN severe_count ELSE 0 END",
    )
    + ") t WHERE total_severe > 0",
    "category_trend": f"""WITH {EVENT}
SELECT year, COUNT(DISTINCT entity_id) AS entities_affected,
  {big("SUM(event_count)", "total_events")}
FROM g_event WHERE category = 'STANDARD' AND year BETWEEN {FIRST} AND {LAST}
GROUP BY year ORDER BY year LIMIT 100""",
    "latest_snapshot": f"""WITH {MART}
SELECT entity_id, year, event_count, declaration_count,
  CAST(loss_score AS DOUBLE) AS loss_score
FROM g_mart WHERE loss_score IS NOT NULL AND year = (SELECT MAX(year) FROM g_mart)""",
    "entity_rank": f"""SELECT entity_id, {big("floor(absolute_increase)", "absolute_increase")},
  RANK() OVER (ORDER BY floor(absolute_increase) DESC) AS rank
FROM ({_INCREASE_SQL}) t""",
    "entity_labels": f"""WITH {ENTITY}
SELECT entity_id, entity_name || ', ' || group_name AS label FROM g_entity""",
    "semi_events": f"""WITH {ENTITY}, {EVENT}
SELECT category, year, {big("SUM(event_count)", "total_events")},
  COUNT(DISTINCT entity_id) AS entities
FROM g_event WHERE entity_id IN
  (SELECT entity_id FROM g_entity WHERE region_name IN ('ASIA', 'EUROPE'))
GROUP BY category, year""",
    "all_zero_check": f"""WITH {EVENT}
SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS nonzero_rows, TRUE AS all_zero,
  'zero_count' AS columns FROM g_event
UNION ALL
SELECT COUNT(*), {big("SUM(CASE WHEN severe_count <> 0 THEN 1 ELSE 0 END)", "nonzero_rows")},
  SUM(severe_count) = 0, 'zero_count,severe_count' FROM g_event""",
    "union_parts": """SELECT o_orderkey, o_orderstatus, o_custkey FROM orders
WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_orderstatus, o_custkey FROM orders
WHERE o_orderstatus NOT IN ('F', 'O')""",
    "resolve_entity": """WITH lookups AS (
  SELECT p_partkey AS lookup_id,
    lower(CASE WHEN p_size % 3 = 0 THEN upper(p_name)
      WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '-')
      ELSE substring(p_name, 1, length(p_name) - 2) END) AS plain,
    CASE WHEN p_size % 2 = 0 THEN p_brand END AS hint FROM part),
keys AS (SELECT DISTINCT plain, hint FROM lookups),
names AS (SELECT p_name, p_brand, MIN(p_partkey) AS p_partkey FROM part
  GROUP BY p_name, p_brand),
ranked AS (
  SELECT plain, hint, p_partkey, p_name, p_brand,
    CASE WHEN lower(p_name) = plain THEN 0
      WHEN lower(p_name) = replace(plain, '-', ' ') THEN 1 ELSE 2 END AS priority
  FROM keys JOIN names ON (lower(p_name) LIKE plain || '%'
      OR lower(p_name) LIKE replace(plain, '-', ' ') || '%')
    AND (hint IS NULL OR hint = p_brand)),
best AS (SELECT *, row_number() OVER (PARTITION BY plain, hint
  ORDER BY priority, p_partkey) AS n FROM ranked)
SELECT lookup_id, p_partkey, p_name, p_brand, CAST(priority AS INTEGER) AS priority
FROM lookups l JOIN best b ON l.plain = b.plain AND l.hint IS NOT DISTINCT FROM b.hint
WHERE n = 1""",
    "ambiguous_names": """WITH pairs AS (SELECT DISTINCT lower(p_name) AS name, p_brand FROM part),
ranked AS (SELECT name, p_brand, row_number() OVER (PARTITION BY name ORDER BY p_brand) AS n,
  COUNT(*) OVER (PARTITION BY name) AS group_count FROM pairs)
SELECT name, group_count, string_agg(p_brand, ',' ORDER BY p_brand) AS groups
FROM ranked WHERE group_count > 1 GROUP BY name, group_count""",
}
