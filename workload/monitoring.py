"""Drift of event values: first half of the month against the second."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions.numeric import cents, rounded
from tallygrid.functions.sizing import bounded_side
from tallygrid.operators import drift
from tallygrid.sources.readers import coerce_numeric, parse_capture, read_capture_window
from tallygrid.sources.shared import shared_path
from tallygrid.streaming.capture import daily_feature_stats
from workload.gold import table

CUT = "2024-01-16"


def long_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feature"), "value", "ts"
    )


def halves(spark, sf_dir):
    rows = long_events(spark, sf_dir)
    cut = F.lit(CUT).cast("timestamp_ntz")
    return rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut)


def _shifted(spark, sf_dir):
    """The recent half with one feature scaled, so that one drift is found."""
    base, recent = halves(spark, sf_dir)
    scaled = F.when(F.col("feature") == "error", F.col("value") * 3.0).otherwise(F.col("value"))
    return base, recent.withColumn("value", scaled)


def _baseline(spark, sf_dir):
    stats = drift.baseline_stats(long_events(spark, sf_dir))
    return stats.select(
        "feature", "rows",
        *[rounded(F.col(c), 6).alias(c) for c in ("mean", "std", "min", "max", "p25", "p50", "p75")],
    )


def _stored(df):
    """A baseline as a job would read it back: features x bins rows, computed once."""
    return bounded_side(df)


def _hist_columns(df):
    return df.select(
        "feature", "bin", rounded(F.col("edge_lo"), 6).alias("edge_lo"), "rows",
        rounded(F.col("share"), 6).alias("share"),
    )


def _histogram(spark, sf_dir):
    return _hist_columns(drift.histogram(long_events(spark, sf_dir)))


def _recent(spark, sf_dir):
    base, recent = _shifted(spark, sf_dir)
    return _hist_columns(drift.recent_histogram(recent, _stored(drift.histogram(base))))


def _kl(spark, sf_dir):
    base, recent = _shifted(spark, sf_dir)
    reference = _stored(drift.histogram(base))
    kl = drift.kl_drift(drift.recent_histogram(recent, reference), reference)
    return kl.select("feature", rounded(F.col("kl_divergence"), 6).alias("kl_divergence"))


def _full_report(spark, sf_dir):
    base, recent = _shifted(spark, sf_dir)
    return drift.drift_report(
        recent, _stored(drift.baseline_stats(base)), _stored(drift.histogram(base))
    )


def _report(spark, sf_dir):
    return _full_report(spark, sf_dir).withColumns(
        {
            "recent_mean": rounded(F.col("recent_mean"), 6),
            "baseline_mean": rounded(F.col("baseline_mean"), 6),
        }
    )


def _summary(spark, sf_dir):
    return drift.drift_summary(_full_report(spark, sf_dir)).withColumn(
        "drifted_features", F.array_join("drifted_features", ",")
    )


def _label_drift(spark, sf_dir):
    base, recent = halves(spark, sf_dir)
    return drift.label_drift(recent, base, "feature")


def _outliers(spark, sf_dir):
    rows = drift.outliers_iqr(long_events(spark, sf_dir))
    return rows.select(
        "feature", "rows", "outliers",
        rounded(F.col("lower_fence"), 6).alias("lower_fence"),
        rounded(F.col("upper_fence"), 6).alias("upper_fence"),
    )


def _daily(spark, sf_dir):
    return daily_feature_stats(long_events(spark, sf_dir)).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "feature", "rows",
        *[rounded(F.col(c), 6).alias(c) for c in ("mean", "min", "max")],
    )


_PROPS = T.StructType([T.StructField("k", T.LongType())])


def _capture(spark, sf_dir):
    rows = parse_capture(table(spark, sf_dir, "events"), "props", _PROPS)
    return rows.select("event_id", F.col("payload.k").alias("k"))


_LINE = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
])


def captured(spark, sf_dir):
    """Events as a capture job leaves them: JSON files by day, every 97th line broken off."""
    path = shared_path(spark, "capture")
    rows = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "event_type", "value"))
    broken = F.substring(line, F.lit(1), F.length(line) - 5)
    (
        rows.select(
            F.when(F.col("event_id") % 97 == 0, broken).otherwise(line).alias("line"),
            F.to_date("ts").alias("date"))
        .write.partitionBy("date").text(path)
    )
    return read_capture_window(spark, path, _LINE, CUT)


def _window(spark, sf_dir):
    """Lines of the second half of the month by day: rows, their sum, and bad lines."""
    window = captured(spark, sf_dir)
    good = window.rows.select(
        F.to_date("ts").alias("date"), F.lit(1).alias("good"),
        cents(F.col("value")).alias("cents"), F.lit(0).alias("bad"))
    bad = window.bad.select(
        "date", F.lit(0).alias("good"), F.lit(0).cast("bigint").alias("cents"),
        F.lit(1).alias("bad"))
    return good.unionByName(bad).groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(
        F.sum("good").alias("rows"), F.sum("cents").alias("cents"), F.sum("bad").alias("bad_lines"))


def _coerce(spark, sf_dir):
    """Two string columns: one holds numbers and blanks, the other holds words."""
    events = table(spark, sf_dir, "events")
    number = F.get_json_object("props", "$.k")
    strings = events.select(
        "event_id",
        F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(number).alias("k"),
        "event_type",
    )
    return coerce_numeric(strings, ["k", "event_type"])


QUERIES = {
    "baseline_stats": _baseline,
    "histogram": _histogram,
    "recent_histogram": _recent,
    "kl_drift": _kl,
    "drift_report": _report,
    "drift_summary": _summary,
    "label_drift": _label_drift,
    "outliers_iqr": _outliers,
    "daily_feature_stats": _daily,
    "capture_json": _capture,
    "capture_window": _window,
    "coerce_numeric": _coerce,
}

_BASE = f"SELECT event_type AS feature, value FROM events WHERE ts < TIMESTAMP '{CUT}'"
_ALL = "SELECT event_type AS feature, value FROM events"
_RECENT = f"""SELECT event_type AS feature,
  CASE WHEN event_type = 'error' THEN value * 3.0 ELSE value END AS value
  FROM events WHERE ts >= TIMESTAMP '{CUT}'"""

_HISTOGRAMS = f"""base AS ({_BASE}), recent AS ({_RECENT}),
ranges AS (SELECT feature,
  CASE WHEN MIN(value) = MAX(value) THEN MIN(value) - 0.5 ELSE MIN(value) END AS lo,
  CASE WHEN MIN(value) = MAX(value) THEN MAX(value) + 0.5 ELSE MAX(value) END AS hi
  FROM base GROUP BY feature),
edges AS (SELECT feature, CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 20) AS edge_lo,
  CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 20) END AS edge_hi
  FROM ranges, (SELECT unnest(generate_series(0, 19)) AS i) g),
base_hist AS (SELECT e.feature, e.bin, e.edge_lo, COUNT(b.value) AS rows
  FROM edges e LEFT JOIN base b ON b.feature = e.feature AND b.value >= e.edge_lo
    AND (b.value < e.edge_hi OR (e.bin = 19 AND b.value <= e.edge_hi))
  GROUP BY e.feature, e.bin, e.edge_lo),
recent_hist AS (SELECT e.feature, e.bin, e.edge_lo, COUNT(b.value) AS rows
  FROM edges e LEFT JOIN recent b ON b.feature = e.feature AND b.value >= e.edge_lo
    AND (b.value < e.edge_hi OR (e.bin = 19 AND b.value <= e.edge_hi))
  GROUP BY e.feature, e.bin, e.edge_lo),
base_share AS (SELECT *, CAST(rows AS DOUBLE) / SUM(rows) OVER (PARTITION BY feature) AS share
  FROM base_hist),
recent_share AS (SELECT *, CAST(rows AS DOUBLE) / SUM(rows) OVER (PARTITION BY feature)
  AS share FROM recent_hist)"""

_KL = """pq AS (SELECT b.feature, r.share + 1e-10 AS p, b.share + 1e-10 AS q
  FROM base_share b JOIN recent_share r ON b.feature = r.feature AND b.bin = r.bin),
norm AS (SELECT feature, p / SUM(p) OVER (PARTITION BY feature) AS p,
  q / SUM(q) OVER (PARTITION BY feature) AS q FROM pq),
kl AS (SELECT feature, SUM(p * ln(p / q)) AS kl FROM norm GROUP BY feature)"""

_HIST = "SELECT feature, bin, ROUND(edge_lo, 6) AS edge_lo, rows, ROUND(share, 6) AS share"

_REPORT = f"""WITH {_HISTOGRAMS}, {_KL},
now AS (SELECT feature, AVG(value) AS m, COUNT(value) AS n FROM recent GROUP BY feature),
old AS (SELECT feature, AVG(value) AS m FROM base GROUP BY feature)
SELECT kl.feature, ROUND(kl, 6) AS kl_divergence, kl > 0.1 AS is_drifted,
  ROUND(now.m, 6) AS recent_mean, ROUND(old.m, 6) AS baseline_mean,
  ROUND(now.m - old.m, 4) AS mean_shift
FROM kl JOIN now ON kl.feature = now.feature JOIN old ON kl.feature = old.feature
WHERE now.n >= 10"""

ORACLES = {
    "baseline_stats": f"""SELECT feature, COUNT(*) AS rows, ROUND(AVG(value), 6) AS mean,
  ROUND(stddev_samp(value), 6) AS std, ROUND(MIN(value), 6) AS min, ROUND(MAX(value), 6) AS max,
  ROUND(quantile_cont(value, 0.25), 6) AS p25, ROUND(quantile_cont(value, 0.5), 6) AS p50,
  ROUND(quantile_cont(value, 0.75), 6) AS p75
FROM ({_ALL}) t GROUP BY feature""",
    "histogram": f"WITH {_HISTOGRAMS.replace(_BASE, _ALL)} {_HIST} FROM base_share",
    "recent_histogram": f"WITH {_HISTOGRAMS} {_HIST} FROM recent_share",
    "kl_drift": f"WITH {_HISTOGRAMS}, {_KL} "
    "SELECT feature, ROUND(kl, 6) AS kl_divergence FROM kl",
    "drift_report": _REPORT,
    "drift_summary": f"""SELECT COUNT(*) AS total_features_checked,
  COALESCE(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE is_drifted), '')
    AS drifted_features,
  COUNT(*) FILTER (WHERE is_drifted) > 0 AS drift_detected FROM ({_REPORT}) t""",
    "label_drift": f"""WITH r AS (SELECT feature, COUNT(*) AS n FROM ({_RECENT}) t
  GROUP BY feature), b AS (SELECT feature, COUNT(*) AS n FROM ({_BASE}) t GROUP BY feature),
shares AS (SELECT CAST(COALESCE(r.n, 0) AS DOUBLE) / (SELECT SUM(n) FROM r) + 1e-10 AS p,
  CAST(COALESCE(b.n, 0) AS DOUBLE) / (SELECT SUM(n) FROM b) + 1e-10 AS q
  FROM r FULL JOIN b ON r.feature = b.feature),
norm AS (SELECT p / SUM(p) OVER () AS p, q / SUM(q) OVER () AS q FROM shares)
SELECT COUNT(*) AS labels, ROUND(SUM(p * ln(p / q)), 6) AS kl_divergence,
  SUM(p * ln(p / q)) > 0.1 AS is_drifted FROM norm""",
    "outliers_iqr": """WITH q AS (SELECT event_type AS feature,
  quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b
  FROM events GROUP BY event_type),
f AS (SELECT feature, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)
SELECT feature, COUNT(*) AS rows,
  CAST(SUM(CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
  ROUND(lo, 6) AS lower_fence, ROUND(hi, 6) AS upper_fence
FROM events JOIN f ON event_type = feature GROUP BY feature, lo, hi""",
    "daily_feature_stats": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS feature,
  COUNT(*) AS rows, ROUND(AVG(value), 6) AS mean, ROUND(MIN(value), 6) AS min,
  ROUND(MAX(value), 6) AS max
FROM events GROUP BY strftime(ts, '%Y-%m-%d'), event_type""",
    "capture_json": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events WHERE json_valid(props)""",
    "capture_window": f"""SELECT strftime(ts, '%Y-%m-%d') AS day,
  CAST(SUM(CASE WHEN event_id % 97 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows,
  CAST(SUM(CASE WHEN event_id % 97 <> 0 THEN CAST(floor(value * 100.0 + 0.5) AS BIGINT)
    ELSE 0 END) AS BIGINT) AS cents,
  CAST(SUM(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_lines
FROM events WHERE ts >= TIMESTAMP '{CUT}' GROUP BY 1""",
    "coerce_numeric": """SELECT event_id, event_type,
  CASE WHEN event_id % 9 = 0 THEN NULL
    ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events""",
}
