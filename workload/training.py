"""Tier models over the entity features, and every scalar function once."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.functions.numeric import first_argmax, guarded_ratio, rounded
from tallygrid.functions.text import first_contained, occurrences, squeeze_whitespace
from tallygrid.operators import bucketing, features, modeling
from tallygrid.schemas import FeatureSpec
from tallygrid.sources.readers import days_before
from workload.features import DAMAGED, FAMILIES, FEATURE_SQL, MAXIMA, MEANS, RATIOS, SUMS
from workload.gold import entity, events, mart, table

# Money totals stay out: the target is cut from one of them.
SPEC = FeatureSpec(
    numeric=(
        "all_events", "all_severe", "all_minor", *[f"{f}_events" for f in FAMILIES],
        "population_total", "home_value", "labor_force", "unemployed", "bachelors", *RATIOS,
    ),
    log=("home_value",),
    categorical=("group_name",),
    passthrough=("entity_id", "risk_bucket", "total_damage", "is_train", "fold"),
)


def examples(spark, sf_dir):
    """Entities with tier, split and fold; the feature table is computed once."""
    wide = features.feature_table(
        features.feature_base(
            mart(spark, sf_dir), entity(spark, sf_dir), SUMS, MEANS, MAXIMA
        ),
        features.category_pivot(events(spark, sf_dir), FAMILIES, DAMAGED),
        RATIOS,
    ).persist()
    tiers = bucketing.tertile_bucket(wide, "total_damage", "entity_id")
    # The portable hash, so that SQL can draw the same rows.
    split = bucketing.stratified_split(
        tiers, "risk_bucket", "entity_id", hasher=bucketing.portable_hash)
    return bucketing.stratified_folds(
        split, "risk_bucket", "entity_id", hasher=bucketing.portable_hash)


def prepared(spark, sf_dir):
    """Training and test rows through features fitted on the training rows only."""
    rows = examples(spark, sf_dir)
    fitted = features.FeaturePipeline(SPEC).fit(rows.filter("is_train"))
    matrix = fitted.transform(rows)
    coded, numeric = features.label_encode(
        matrix, passthrough=[c for c in SPEC.passthrough if c != "risk_bucket"]
    )
    return coded.persist(), numeric


def _model(spark, sf_dir, kind="forest"):
    """A model of the training rows; boosting is judged on the others, as they are no part of it."""
    coded, numeric = prepared(spark, sf_dir)
    held = coded.filter("NOT is_train")
    model = modeling.train_classifier(
        coded.filter("is_train"), numeric, kind=kind, judged=held, key="entity_id")
    return model, coded, numeric


def held_out(spark, sf_dir, kind):
    """Held-out rows of every tier, and whether the tiers were told apart better than by chance."""
    model, coded, _ = _model(spark, sf_dir, kind)
    scored = model.transform(coded.filter("NOT is_train")).select("label", "prediction")
    report = modeling.classification_report(scored).filter("support > 0")
    chance = F.avg("recall").over(Window.partitionBy(F.lit(1))) > 1.0 / len(features.LABELS)
    return report.select(F.col("class").alias("actual"), F.col("support").alias("rows"),
                         chance.alias("beats_chance"))


def _train(spark, sf_dir):
    return held_out(spark, sf_dir, "forest")


def _boosted(spark, sf_dir):
    return held_out(spark, sf_dir, "boosted")


def _cv(spark, sf_dir):
    """Every fold once with its rows; scores are shares and the mean is theirs."""
    coded, numeric = prepared(spark, sf_dir)
    scores = modeling.cv_scores(coded.filter("is_train"), numeric)
    mean = F.avg("balanced_accuracy").over(Window.partitionBy(F.lit(1)))
    return scores.select(
        "fold", "rows", F.col("balanced_accuracy").between(0.0, 1.0).alias("is_share"),
        (F.abs(mean - F.col("mean")) < 1e-9).alias("mean_of_folds"))


def _score(spark, sf_dir):
    """Every entity once; its tier is the most probable one and its probabilities add up."""
    model, coded, _ = _model(spark, sf_dir)
    scored = modeling.batch_score(model, coded, ["entity_id"])
    chances = F.map_values("probabilities")
    total = F.aggregate(chances, F.lit(0.0), lambda a, p: a + p)
    return scored.select(
        "entity_id", (F.abs(total - 1.0) < 0.02).alias("adds_up"),
        (F.col("probabilities")[F.col("risk_bucket")] == F.array_max(chances)).alias("is_most"),
        F.element_at(F.array(*map(F.lit, features.LABELS)), F.col("predicted_class") + 1)
        .eqNullSafe(F.col("risk_bucket")).alias("is_class"))


def _importance(spark, sf_dir):
    """The twenty most important features by place; all shares add up to one."""
    model, _, numeric = _model(spark, sf_dir)
    top = modeling.feature_importance(model, numeric)
    total = modeling.feature_importance(model, numeric, len(numeric)).agg(
        F.sum("importance")).first()[0]
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    before = F.lag("importance").over(Window.orderBy(F.desc("importance"), "feature"))
    return top.select(
        place.alias("place"), F.coalesce(before >= F.col("importance"), F.lit(True)).alias("falls"),
        (F.lit(abs(total - 1.0)) < 1e-9).alias("adds_up"))


def _scalars(spark, sf_dir):
    """Every scalar function that the operators are made of, over all customers."""
    name, balance, key = F.col("c_name"), F.col("c_acctbal"), F.col("c_custkey")
    padded = F.concat(F.lit("  "), name, F.lit(" \t\n"), F.col("c_mktsegment"), F.lit(" "))
    numbers = F.regexp_extract_all(name, F.lit(r"([1-9])"), F.lit(1))
    digits = F.transform(numbers, lambda x: x.cast("int"))
    odds = F.array(balance % 7, balance % 5, balance % 3)
    labels = F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH"))
    year = F.lit(1995) + key % 7
    json_text = F.concat(F.lit('{"k": '), (key % 97).cast("string"), F.lit("}"))
    broken = F.when(key % 2 == 0, json_text).otherwise(F.lit("{oops"))
    moment = F.lit("2024-03-01 10:00:00").cast("timestamp")
    known = F.create_map(*[
        part for i, s in enumerate(("AUTOMOBILE", "BUILDING")) for part in (F.lit(s), F.lit(i))
    ])
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        rounded(balance / 3, 2).alias("rounded"),
        rounded(balance + balance * 2 - balance / 4, 4).alias("arithmetic"),
        rounded(F.log1p(F.greatest(balance, F.lit(0.0))), 6).alias("log1p"),
        rounded(F.ln(F.abs(balance) + 1), 6).alias("ln"),
        F.expr("CAST((c_custkey + 2023) div 2 AS BIGINT)").alias("halved"),
        F.least(key, F.lit(100)).cast("bigint").alias("capped"),
        first_argmax(odds).alias("argmax"),
        F.coalesce(F.nullif(key % 7, F.lit(0)), F.lit(-1)).cast("bigint").alias("coalesced"),
        guarded_ratio(key, key % 2).alias("ratio"),
        F.nullif(key % 4, F.lit(0)).isNotNull().alias("not_null"),
        F.when(balance > 5000, "high").when(balance > 0, "low").otherwise("debt").alias("case"),
        F.coalesce(known[F.col("c_mktsegment")], F.lit(-1)).alias("mapped"),
        F.concat(name, F.lit("x")).try_cast("int").isNull().alias("uncast"),
        F.substring(name, 10, 9).try_cast("int").alias("number"),
        F.lower(name).alias("lower"),
        F.initcap(F.lower(F.col("c_mktsegment"))).alias("title"),
        F.col("c_mktsegment").startswith("B").alias("starts"),
        F.col("c_mktsegment").endswith("E").alias("ends"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("replaced"),
        squeeze_whitespace(padded).alias("squeezed"),
        F.substring(name, 1, 12).alias("slice"),
        name.contains("0001").alias("contains"),
        first_contained(F.lower("c_mktsegment"), {"build": "b", "mach": "m"}, "-").alias("first"),
        F.concat_ws(", ", "c_mktsegment", name).alias("joined"),
        F.size(F.filter(F.split(name, "#"), lambda w: F.length(w) > 8)).alias("long_words"),
        occurrences(name, "0").alias("zeros"),
        F.regexp_count(name, F.lit("0")).alias("zero_matches"),
        F.length(name).alias("length"),
        F.format_number(balance / 1e5, 2).alias("formatted"),
        name.rlike(r"^Customer#\d{9}$").alias("valid"),
        F.regexp_extract(name, r"#0*(\d+)", 1).alias("extracted"),
        F.array_join(numbers, "").alias("digits"),
        F.regexp_replace(name, "[^0-9]", "").alias("only_digits"),
        F.md5(F.concat(name, F.lit("::"), key.cast("string"))).alias("md5"),
        F.array_join(F.transform(F.sequence(F.lit(0), key % 5), lambda i: i * 3), ",").alias(
            "strided"
        ),
        F.array_join(F.slice(numbers, 1, 2), "").alias("first_two"),
        F.array_join(F.array_sort(F.array_distinct(numbers)), "").alias("distinct"),
        F.coalesce(F.array_max(digits) - F.array_min(digits), F.lit(-1)).alias("spread"),
        rounded(
            F.map_from_arrays(labels, odds)[F.lit("HIGH")], 2
        ).alias("map_value"),
        F.coalesce(F.from_json(broken, "k bigint")["k"], F.lit(-1)).alias("json_k"),
        F.get_json_object(F.to_json(F.struct(key.alias("k"))), "$.k").alias("json_text"),
        F.date_format(days_before(moment, 7), "yyyy-MM-dd").alias("week_before"),
        year.cast("bigint").alias("year"),
    )


QUERIES = {
    "train_classifier": _train,
    "train_boosted": _boosted,
    "cv_scores": _cv,
    "batch_score": _score,
    "feature_importance": _importance,
    "scalar_smoke": _scalars,
}

_ODDS = "[c_acctbal % 7, c_acctbal % 5, c_acctbal % 3]"
_DIGITS = "regexp_extract_all(c_name, '([1-9])', 1)"
_INTS = f"list_transform({_DIGITS}, lambda x: CAST(x AS INTEGER))"

_EXAMPLES = f"""f AS (SELECT entity_id, total_damage FROM ({FEATURE_SQL}) t),
edges AS (SELECT quantile_cont(total_damage, 1.0 / 3.0) AS lo,
  quantile_cont(total_damage, 2.0 / 3.0) AS hi FROM f),
tier AS (SELECT entity_id, CAST(CASE WHEN total_damage <= lo THEN 0 WHEN total_damage <= hi THEN 1
  ELSE 2 END AS INTEGER) AS actual FROM f, edges),
drawn AS (SELECT *, COUNT(*) OVER (PARTITION BY actual) AS total,
  row_number() OVER (PARTITION BY actual ORDER BY
    substring(md5('42:' || CAST(entity_id AS VARCHAR)), 1, 13)) AS n,
  row_number() OVER (PARTITION BY actual ORDER BY
    substring(md5('42:fold:' || CAST(entity_id AS VARCHAR)), 1, 13)) AS m FROM tier),
examples AS (SELECT entity_id, actual, n <= floor(total * 0.8 + 0.5) AS is_train,
  CAST(CASE WHEN m > ceil(total * 1 / 5.0) THEN 1 ELSE 0 END
  + CASE WHEN m > ceil(total * 2 / 5.0) THEN 1 ELSE 0 END
  + CASE WHEN m > ceil(total * 3 / 5.0) THEN 1 ELSE 0 END
  + CASE WHEN m > ceil(total * 4 / 5.0) THEN 1 ELSE 0 END AS INTEGER) AS fold FROM drawn)"""
_HELD_OUT = f"""WITH {_EXAMPLES}
SELECT actual, COUNT(*) AS rows, TRUE AS beats_chance FROM examples WHERE NOT is_train
GROUP BY actual"""

ORACLES = {
    "train_classifier": _HELD_OUT,
    "train_boosted": _HELD_OUT,
    "cv_scores": f"""WITH {_EXAMPLES}
SELECT fold, COUNT(*) AS rows, TRUE AS is_share, TRUE AS mean_of_folds FROM examples
WHERE is_train GROUP BY fold""",
    "batch_score": f"""WITH {_EXAMPLES}
SELECT entity_id, TRUE AS adds_up, TRUE AS is_most, TRUE AS is_class FROM examples""",
    "feature_importance": """SELECT CAST(i AS INTEGER) AS place, TRUE AS falls, TRUE AS adds_up
FROM (SELECT unnest(generate_series(1, 20)) AS i) t""",
    "scalar_smoke": f"""SELECT c_custkey,
  ROUND(c_acctbal / 3, 2) AS rounded,
  ROUND(c_acctbal + c_acctbal * 2 - c_acctbal / 4, 4) AS arithmetic,
  ROUND(ln(1 + greatest(c_acctbal, 0)), 6) AS log1p, ROUND(ln(abs(c_acctbal) + 1), 6) AS ln,
  (c_custkey + 2023) // 2 AS halved, least(c_custkey, 100) AS capped,
  CAST(list_position({_ODDS}, list_max({_ODDS})) - 1 AS INTEGER) AS argmax,
  COALESCE(NULLIF(c_custkey % 7, 0), -1) AS coalesced,
  CASE WHEN c_custkey % 2 > 0 THEN CAST(c_custkey AS DOUBLE) / (c_custkey % 2) END AS ratio,
  NULLIF(c_custkey % 4, 0) IS NOT NULL AS not_null,
  CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' ELSE 'debt' END AS case,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 ELSE -1 END AS mapped,
  TRY_CAST(c_name || 'x' AS INTEGER) IS NULL AS uncast,
  TRY_CAST(substring(c_name, 10, 9) AS INTEGER) AS number, lower(c_name) AS lower,
  substring(c_mktsegment, 1, 1) || lower(substring(c_mktsegment, 2)) AS title,
  starts_with(c_mktsegment, 'B') AS starts, ends_with(c_mktsegment, 'E') AS ends,
  replace(c_name, '#', '-') AS replaced, c_name || ' ' || c_mktsegment AS squeezed,
  substring(c_name, 1, 12) AS slice, contains(c_name, '0001') AS contains,
  CASE WHEN contains(c_mktsegment, 'BUILD') THEN 'b' WHEN contains(c_mktsegment, 'MACH')
    THEN 'm' ELSE '-' END AS first,
  c_mktsegment || ', ' || c_name AS joined,
  CAST(len(list_filter(string_split(c_name, '#'), lambda w: length(w) > 8)) AS INTEGER)
    AS long_words,
  CAST(length(c_name) - length(replace(c_name, '0', '')) AS INTEGER) AS zeros,
  CAST(length(c_name) - length(replace(c_name, '0', '')) AS INTEGER) AS zero_matches,
  CAST(length(c_name) AS INTEGER) AS length, printf('%.2f', c_acctbal / 1e5) AS formatted,
  regexp_full_match(c_name, 'Customer#\\d{{9}}') AS valid,
  regexp_extract(c_name, '#0*(\\d+)', 1) AS extracted,
  COALESCE(array_to_string({_DIGITS}, ''), '') AS digits,
  regexp_replace(c_name, '[^0-9]', '', 'g') AS only_digits,
  md5(c_name || '::' || c_custkey) AS md5,
  array_to_string(list_transform(generate_series(0, c_custkey % 5), lambda i: i * 3), ',')
    AS strided,
  COALESCE(array_to_string({_DIGITS}[1:2], ''), '') AS first_two,
  COALESCE(array_to_string(list_sort(list_distinct({_DIGITS})), ''), '') AS distinct,
  COALESCE(list_max({_INTS}) - list_min({_INTS}), -1) AS spread,
  ROUND(c_acctbal % 3, 2) AS map_value,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 97 ELSE -1 END AS json_k,
  CAST(c_custkey AS VARCHAR) AS json_text,
  strftime(TIMESTAMP '2024-03-01 10:00:00' - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before,
  1995 + c_custkey % 7 AS year
FROM customer""",
}
