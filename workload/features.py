"""Feature building, tiers, splits and folds over the gold tables and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions.numeric import rounded
from tallygrid.operators import bucketing, features
from tallygrid.schemas import FeatureSpec
from workload.gold import ENTITY, EVENT, MART, big, entity, events, mart, mean, table

SUMS = (
    "registrations", "total_damage", "approved_amount", "declaration_count", "repair_amount",
    "rental_amount", "other_amount", "inspected",
)
MEANS = (
    "population_total", "home_value", "labor_force", "unemployed", "bachelors", "event_count",
    "minor_count", "severe_count", "avg_damage",
)
MAXIMA = ("loss_score", "risk_score", "vulnerability_score", "resilience_score")

# Families of part types; they overlap, as event families may.
FAMILIES = {
    "bulk": ("LARGE", "MEDIUM", "STANDARD"),
    "small": ("SMALL",),
    "promo": ("PROMO",),
    "cheap": ("ECONOMY", "SMALL"),
    "medium": ("MEDIUM",),
}
DAMAGED = ("bulk", "small", "promo")
RATIOS = {
    "unemployment_rate": ("unemployed", "labor_force"),
    "bachelors_rate": ("bachelors", "population_total"),
    "events_per_capita": ("all_events", "population_total"),
}


def _rounded_doubles(df, places=4):
    """Doubles rounded and integers widened, for comparison between engines."""
    return df.select(
        [
            rounded(F.col(f.name), places).alias(f.name)
            if f.dataType.typeName() in ("double", "decimal")
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _base(spark, sf_dir):
    return features.feature_base(
        mart(spark, sf_dir), entity(spark, sf_dir), SUMS, MEANS, MAXIMA
    )


def _pivot(spark, sf_dir):
    return features.category_pivot(events(spark, sf_dir), FAMILIES, DAMAGED)


def _table(spark, sf_dir):
    return features.feature_table(_base(spark, sf_dir), _pivot(spark, sf_dir), RATIOS)


def _feature_base(spark, sf_dir):
    return _rounded_doubles(_base(spark, sf_dir))


def _category_pivot(spark, sf_dir):
    return _rounded_doubles(_pivot(spark, sf_dir))


def _feature_table(spark, sf_dir):
    return _rounded_doubles(_table(spark, sf_dir))


def _entity_features(spark, sf_dir):
    chosen = entity(spark, sf_dir).filter(F.col("region_name") == "ASIA")
    return _rounded_doubles(features.entity_features(_table(spark, sf_dir), chosen))


def _ratios(spark, sf_dir):
    rows = mart(spark, sf_dir).withColumn("even_years", F.col("event_count") % 2)
    ratios = {
        "severe_rate": ("severe_count", "event_count"),
        "odd_rate": ("severe_count", "even_years"),
    }
    return _rounded_doubles(
        features.guarded_ratios(rows, ratios).select(
            "entity_id", "year", "severe_rate", "odd_rate"
        ),
        6,
    )


def _gappy(spark, sf_dir):
    """The mart with NULLs where the event count is a multiple of seven."""
    count = F.col("event_count")
    return mart(spark, sf_dir).select(
        "entity_id",
        "year",
        "severe_count",
        "total_damage",
        F.when(count % 7 != 0, count).alias("events"),
    )


def _align(spark, sf_dir):
    wanted = ["severe_count", "absent_feature", "events"]
    rows = _gappy(spark, sf_dir)
    aligned = features.align_features(rows, wanted)
    keys = features.align_features(rows, ["entity_id", "year", *wanted])
    assert aligned.columns == wanted
    return keys


def _align_train_test(spark, sf_dir):
    rows = _gappy(spark, sf_dir)
    train = rows.filter(F.col("year") < 2000).withColumn("only_train", F.lit(1))
    test = rows.filter(F.col("year") >= 2000).withColumn("only_test", F.lit(1))
    left, right = features.align_train_test(train, test)
    return _rounded_doubles(left.unionByName(right), 2)


def _drop_incomplete(spark, sf_dir):
    return _rounded_doubles(features.drop_incomplete(_gappy(spark, sf_dir)), 2)


def _lags(spark, sf_dir):
    rows = mart(spark, sf_dir).select("entity_id", "year", "event_count")
    return features.lag_features(rows, ["event_count", "absent"], (1, 2, 3))


def _logs(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return _rounded_doubles(features.log_features(rows, ["c_acctbal", "absent"]), 6)


def _impute(spark, sf_dir):
    rows = _gappy(spark, sf_dir).select("entity_id", "year", "events", "severe_count")
    filled = features.median_impute(rows, ["events", "severe_count", "absent"])
    return _rounded_doubles(filled)


def _one_hot(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return features.one_hot(rows, ["c_mktsegment"])


SPEC = FeatureSpec(
    numeric=("events", "severe_count"),
    log=("total_damage",),
    lag=("events",),
    lags=(1,),
    categorical=("region_name",),
)


def _matrix(spark, sf_dir):
    rows = _gappy(spark, sf_dir).join(
        entity(spark, sf_dir).select("entity_id", "entity_name", "region_name"), "entity_id"
    )
    return _rounded_doubles(features.FeaturePipeline(SPEC).fit(rows).transform(rows))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")


def _tertile(spark, sf_dir):
    rows = bucketing.tertile_bucket(_customers(spark, sf_dir), "c_acctbal", "c_custkey")
    return rows.select("c_custkey", "risk_bucket")


def _tied(spark, sf_dir):
    """Balances above 6000 only: most customers tie at zero."""
    return _customers(spark, sf_dir).withColumn(
        "excess", F.greatest(F.col("c_acctbal") - 6000, F.lit(0.0))
    )


def _tertile_rank(spark, sf_dir):
    rows = bucketing.tertile_bucket(_tied(spark, sf_dir), "excess", "c_custkey")
    return rows.select("c_custkey", "risk_bucket")


def _split(spark, sf_dir):
    rows = bucketing.stratified_split(
        _customers(spark, sf_dir), "c_mktsegment", "c_custkey", hasher=bucketing.portable_hash
    )
    return rows.select("c_custkey", "is_train")


def _folds(spark, sf_dir):
    rows = bucketing.stratified_folds(
        _customers(spark, sf_dir), "c_mktsegment", "c_custkey", hasher=bucketing.portable_hash
    )
    return rows.select("c_custkey", "fold")


def _label_encode(spark, sf_dir):
    rows = bucketing.tertile_bucket(_customers(spark, sf_dir), "c_acctbal", "c_custkey")
    coded, numeric = features.label_encode(rows, passthrough=("c_custkey",))
    return coded.select("c_custkey", "label", F.lit(",".join(numeric)).alias("features"))


QUERIES = {
    "feature_base": _feature_base,
    "category_pivot": _category_pivot,
    "feature_table": _feature_table,
    "entity_features": _entity_features,
    "guarded_ratios": _ratios,
    "align_features": _align,
    "align_train_test": _align_train_test,
    "drop_incomplete": _drop_incomplete,
    "lag_features": _lags,
    "log_features": _logs,
    "median_impute": _impute,
    "one_hot": _one_hot,
    "feature_matrix": _matrix,
    "tertile_bucket": _tertile,
    "tertile_by_rank": _tertile_rank,
    "stratified_split": _split,
    "stratified_folds": _folds,
    "label_encode": _label_encode,
}


_COUNT_SUMS = ("registrations", "declaration_count", "inspected")

BASE_SQL = f"""base AS (
  SELECT m.entity_id, e.group_name,
    {", ".join(big(f"SUM({c})", c) if c in _COUNT_SUMS else f"SUM({c}) AS {c}" for c in SUMS)},
    {", ".join(f"{mean(c)} AS {c}" for c in MEANS)},
    {", ".join(f"CAST(MAX({c}) AS DOUBLE) AS {c}" for c in MAXIMA)}
  FROM g_mart m LEFT JOIN g_entity e ON m.entity_id = e.entity_id
  WHERE loss_score IS NOT NULL GROUP BY m.entity_id, e.group_name)"""


def _family_sql(family: str) -> str:
    members = ", ".join(f"'{m}'" for m in FAMILIES[family])
    hit = f"category IN ({members})"
    parts = [f"CAST(SUM(CASE WHEN {hit} THEN event_count ELSE 0 END) AS BIGINT) "
             f"AS {family}_events"]
    if family in DAMAGED:
        parts.append(
            f"SUM(CASE WHEN {hit} THEN CAST(event_count AS DOUBLE) * "
            f"COALESCE(CAST(avg_damage AS DOUBLE), 0) ELSE 0 END) AS {family}_total_damage"
        )
    return ", ".join(parts)


PIVOT_SQL = f"""e_pivot AS (
  SELECT entity_id, {big("SUM(event_count)", "all_events")},
    {big("SUM(severe_count)", "all_severe")}, {big("SUM(minor_count)", "all_minor")},
    {mean("avg_damage")} AS mean_damage,
    SUM(CAST(event_count AS DOUBLE) * COALESCE(CAST(avg_damage AS DOUBLE), 0))
      AS all_total_damage,
    {", ".join(_family_sql(f) for f in FAMILIES)}
  FROM g_event GROUP BY entity_id)"""

_PIVOT_COUNTS = ["all_events", "all_severe", "all_minor"] + [f"{f}_events" for f in FAMILIES]
_PIVOT_DOUBLES = ["mean_damage", "all_total_damage"] + [f"{f}_total_damage" for f in DAMAGED]
_BASE_DOUBLES = [c for c in SUMS if c not in _COUNT_SUMS] + [*MEANS, *MAXIMA]


def _round_list(columns, places=4, source="") -> str:
    return ", ".join(f"ROUND({source}{c}, {places}) AS {c}" for c in columns)


def _feature_sql(with_damage: bool, where: str = "") -> str:
    doubles = _PIVOT_DOUBLES if with_damage else ["mean_damage"]
    base = [c for c in _BASE_DOUBLES if with_damage or not c.endswith("total_damage")]
    ratios = ", ".join(
        f"CASE WHEN {d} > 0 THEN ROUND(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE), 4) END AS {r}"
        for r, (n, d) in RATIOS.items()
    )
    return f"""WITH {ENTITY}, {MART}, {EVENT}, {BASE_SQL}, {PIVOT_SQL}
SELECT b.entity_id, b.group_name, {", ".join(f"b.{c}" for c in _COUNT_SUMS)},
  {_round_list(base, source="b.")},
  {", ".join(f"COALESCE(p.{c}, 0) AS {c}" for c in _PIVOT_COUNTS)},
  {", ".join(f"ROUND(COALESCE(p.{c}, 0), 4) AS {c}" for c in doubles)}, {ratios}
FROM base b LEFT JOIN e_pivot p ON b.entity_id = p.entity_id{where}"""


FEATURE_SQL = _feature_sql(True)

_GAPPY = f"""{MART}, gappy AS (SELECT entity_id, year, {big("severe_count")}, total_damage,
  CASE WHEN event_count % 7 <> 0 THEN event_count END AS events FROM g_mart)"""

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _split_order(salt: str = "42:") -> str:
    return (
        "row_number() OVER (PARTITION BY c_mktsegment ORDER BY "
        f"substring(md5('{salt}' || CAST(c_custkey AS VARCHAR)), 1, 13)) AS n, "
        "COUNT(*) OVER (PARTITION BY c_mktsegment) AS total"
    )


_TIERS = """CASE WHEN c_acctbal <= lo THEN 'LOW' WHEN c_acctbal <= hi THEN 'MEDIUM'
  ELSE 'HIGH' END"""
_EDGES = """edges AS (SELECT quantile_cont(c_acctbal, 1.0 / 3.0) AS lo,
  quantile_cont(c_acctbal, 2.0 / 3.0) AS hi FROM customer)"""

ORACLES = {
    "feature_base": f"""WITH {ENTITY}, {MART}, {BASE_SQL}
SELECT entity_id, group_name, {", ".join(_COUNT_SUMS)}, {_round_list(_BASE_DOUBLES)}
FROM base""",
    "category_pivot": f"""WITH {EVENT}, {PIVOT_SQL}
SELECT entity_id, {", ".join(_PIVOT_COUNTS)}, {_round_list(_PIVOT_DOUBLES)} FROM e_pivot""",
    "feature_table": _feature_sql(True),
    "entity_features": _feature_sql(
        False,
        " WHERE b.entity_id IN (SELECT entity_id FROM g_entity WHERE region_name = 'ASIA')",
    ),
    "guarded_ratios": f"""WITH {MART}
SELECT entity_id, year,
  CASE WHEN event_count > 0 THEN ROUND(CAST(severe_count AS DOUBLE) / event_count, 6) END
    AS severe_rate,
  CASE WHEN event_count % 2 > 0 THEN ROUND(CAST(severe_count AS DOUBLE), 6) END AS odd_rate
FROM g_mart""",
    "align_features": f"""WITH {_GAPPY}
SELECT CAST(entity_id AS DOUBLE) AS entity_id, CAST(year AS DOUBLE) AS year,
  CAST(severe_count AS DOUBLE) AS severe_count, CAST(0 AS DOUBLE) AS absent_feature,
  CAST(COALESCE(events, 0) AS DOUBLE) AS events FROM gappy""",
    "align_train_test": f"""WITH {_GAPPY}
SELECT entity_id, year, severe_count, ROUND(total_damage, 2) AS total_damage, events
FROM gappy""",
    "drop_incomplete": f"""WITH {_GAPPY}
SELECT entity_id, year, severe_count, ROUND(total_damage, 2) AS total_damage, events
FROM gappy WHERE events IS NOT NULL""",
    "lag_features": f"""WITH {MART}
SELECT entity_id, year, event_count,
  LAG(event_count, 1) OVER w AS event_count_lag1,
  LAG(event_count, 2) OVER w AS event_count_lag2,
  LAG(event_count, 3) OVER w AS event_count_lag3
FROM g_mart WINDOW w AS (PARTITION BY entity_id ORDER BY year)""",
    "log_features": """SELECT c_custkey, ROUND(c_acctbal, 6) AS c_acctbal,
  ROUND(ln(1 + greatest(c_acctbal, 0)), 6) AS c_acctbal_log FROM customer""",
    "median_impute": f"""WITH {_GAPPY}
SELECT entity_id, year,
  ROUND(COALESCE(CAST(events AS DOUBLE), (SELECT quantile_cont(events, 0.5) FROM gappy)), 4)
    AS events,
  ROUND(CAST(severe_count AS DOUBLE), 4) AS severe_count FROM gappy""",
    "one_hot": "SELECT c_custkey, "
    + ", ".join(
        f'CAST(CASE WHEN c_mktsegment = \'{s}\' THEN 1 ELSE 0 END AS DOUBLE) '
        f'AS "c_mktsegment_{s}"'
        for s in _SEGMENTS[1:]
    )
    + " FROM customer",
    "feature_matrix": f"""WITH {ENTITY}, {_GAPPY},
filled AS (SELECT g.entity_id, year, CAST(severe_count AS DOUBLE) AS severe_count,
  total_damage, region_name,
  COALESCE(CAST(events AS DOUBLE), (SELECT quantile_cont(events, 0.5) FROM gappy)) AS events
  FROM gappy g JOIN g_entity e ON g.entity_id = e.entity_id),
lagged AS (SELECT *, LAG(events, 1) OVER (PARTITION BY entity_id ORDER BY year) AS before
  FROM filled)
SELECT entity_id, year, ROUND(severe_count, 4) AS severe_count,
  ROUND(total_damage, 4) AS total_damage, ROUND(events, 4) AS events,
  ROUND(ln(1 + total_damage), 4) AS total_damage_log, """
    + ", ".join(
        f"CAST(CASE WHEN region_name = '{r}' THEN 1 ELSE 0 END AS DOUBLE) "
        f'AS "region_name_{r}"'
        for r in _REGIONS[1:]
    )
    + " FROM lagged WHERE before IS NOT NULL",
    "tertile_bucket": f"""WITH {_EDGES}
SELECT c_custkey, {_TIERS} AS risk_bucket FROM customer, edges""",
    "tertile_by_rank": """WITH ranked AS (SELECT c_custkey,
  row_number() OVER (ORDER BY greatest(c_acctbal - 6000, 0), c_custkey) AS r,
  COUNT(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN r <= 1 + (n - 1) / 3.0 THEN 'LOW'
  WHEN r <= 1 + 2 * (n - 1) / 3.0 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_bucket FROM ranked""",
    "stratified_split": f"""SELECT c_custkey, n <= floor(total * 0.8 + 0.5) AS is_train
FROM (SELECT c_custkey, {_split_order()} FROM customer) t""",
    "stratified_folds": f"""SELECT c_custkey, CAST(
  CASE WHEN n > ceil(total * 1 / 5.0) THEN 1 ELSE 0 END
  + CASE WHEN n > ceil(total * 2 / 5.0) THEN 1 ELSE 0 END
  + CASE WHEN n > ceil(total * 3 / 5.0) THEN 1 ELSE 0 END
  + CASE WHEN n > ceil(total * 4 / 5.0) THEN 1 ELSE 0 END AS INTEGER) AS fold
FROM (SELECT c_custkey, {_split_order('42:fold:')} FROM customer) t""",
    "label_encode": f"""WITH {_EDGES}
SELECT c_custkey, CASE {_TIERS} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS label,
  'c_acctbal' AS features FROM customer, edges""",
}
