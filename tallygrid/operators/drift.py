"""Distribution drift against a stored baseline.

Long form throughout: one row per (feature, value).  A hot feature is fine: every
shuffle is on partially aggregated (feature, bin) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import rounded
from ..functions.selection import exact_quantiles, null_safe
from ..functions.sizing import bounded_side

BINS = 20
EPSILON = 1e-10
KL_THRESHOLD = 0.1
MIN_ROWS = 10


def to_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows of a wide frame, after the columns ``keep``.

    Absent columns and NULLs are skipped.
    """
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in features
        if c in df.columns
    ]
    if not pairs:
        return df.select(*keep, F.lit("").alias("feature"), F.lit(0.0).alias("value")).filter("false")
    return df.select(*keep, F.inline(F.array(*pairs))).filter("value IS NOT NULL")


def baseline_stats(long: DataFrame) -> DataFrame:
    """Rows, mean, sample std, min, max and quartiles per feature."""
    known = long.filter("value IS NOT NULL")
    moments = known.groupBy("feature").agg(
        F.count("*").alias("rows"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(
        known, ["feature"], "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"]
    )
    return null_safe(moments, quartiles, ["feature"])


def value_ranges(long: DataFrame) -> DataFrame:
    """Histogram range per feature; a constant feature gets its value plus/minus a half."""
    low, high = F.min("value"), F.max("value")
    flat = F.col("lo") == F.col("hi")
    return (
        long.filter("value IS NOT NULL")
        .groupBy("feature")
        .agg(low.alias("lo"), high.alias("hi"))
        .select(
            "feature",
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
    )


def bin_edge(i: Column, bins: int) -> Column:
    """Left edge of bin ``i``; the last edge is the maximum itself."""
    lo, hi = F.col("lo"), F.col("hi")
    return F.when(i >= bins, hi).otherwise(lo + i * ((hi - lo) / bins))


def bin_index(value: Column, bins: int) -> Column:
    """Equal-width bin of a value inside [lo, hi]; the last bin is closed.

    The quotient may land one bin off next to an edge, so edges have the last word.
    """
    lo, hi = F.col("lo"), F.col("hi")
    guess = F.least(F.floor((value - lo) * bins / (hi - lo)), F.lit(bins - 1))
    return (
        F.when(value < bin_edge(guess, bins), guess - 1)
        .when((value >= bin_edge(guess + 1, bins)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
        .cast("int")
    )


def histogram_on(long: DataFrame, ranges: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts and shares on given ranges: a full grid of bins, values outside dropped."""
    side = bounded_side(ranges.select("feature", "lo", "hi"))
    counted = (
        long.filter("value IS NOT NULL")
        .join(side, "feature")
        .filter("value BETWEEN lo AND hi")
        .groupBy("feature", bin_index(F.col("value"), bins).alias("bin"))
        .agg(F.count("*").alias("rows"))
    )
    grid = side.select(
        "feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    kept = F.coalesce("rows", F.lit(0))
    # A window partition is the bins of one feature.
    total = F.sum(kept).over(Window.partitionBy("feature"))
    return grid.join(counted, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        bin_edge(F.col("bin"), bins).alias("edge_lo"),
        bin_edge(F.col("bin") + 1, bins).alias("edge_hi"),
        kept.alias("rows"),
        F.coalesce(F.try_divide(kept.cast("double"), total), F.lit(0.0)).alias("share"),
    )


def histogram(long: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width histogram per feature over its own range."""
    return histogram_on(long, value_ranges(long), bins)


def histogram_ranges(baseline: DataFrame) -> DataFrame:
    """The (lo, hi) of a stored histogram."""
    return baseline.groupBy("feature").agg(
        F.min("edge_lo").alias("lo"), F.max("edge_hi").alias("hi")
    )


def recent_histogram(long: DataFrame, baseline: DataFrame, bins: int = BINS) -> DataFrame:
    """Recent rows counted on the baseline's bins."""
    return histogram_on(long, histogram_ranges(baseline), bins)


def kl_drift(recent: DataFrame, baseline: DataFrame, eps: float = EPSILON) -> DataFrame:
    """KL(recent || baseline) per feature; ``eps`` is added to each bin, then renormalised."""
    p, q = F.col("_p") + eps, F.col("_q") + eps
    pairs = baseline.select("feature", "bin", F.col("share").alias("_q")).join(
        recent.select("feature", "bin", F.col("share").alias("_p")), ["feature", "bin"]
    )
    # sum p' ln(p'/q') with p' = p/P, q' = q/Q  =  sum(p ln(p/q))/P + ln(Q/P)
    sums = pairs.groupBy("feature").agg(
        F.sum(p * F.ln(p / q)).alias("_s"), F.sum(p).alias("_tp"), F.sum(q).alias("_tq")
    )
    kl = F.col("_s") / F.col("_tp") + F.ln(F.col("_tq") / F.col("_tp"))
    return sums.select("feature", kl.alias("kl_divergence"))


def binned_counts(
    long: DataFrame, baseline_histogram: DataFrame, by: Sequence[Column] = (), bins: int = BINS
) -> DataFrame:
    """Per feature, and ``by``: rows, mean and the counts on the baseline's bins, in one pass.

    Sums and counts only, so it serves a table and, kept as state, a stream alike.  Values
    outside of the baseline's range count as rows but fall into no bin; features without a
    baseline are left out.
    """
    side = bounded_side(histogram_ranges(baseline_histogram))
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    placed = (
        long.filter("value IS NOT NULL").join(side, "feature")
        .withColumn("_bin", F.when(inside, bin_index(F.col("value"), bins)))
    )
    return placed.groupBy(*by, "feature").agg(
        F.count("*").alias("rows"), F.avg("value").alias("recent_mean"),
        F.array(*[F.count_if(F.col("_bin") == i) for i in range(bins)]).alias("counts"),
    )


def report_of(
    counts: DataFrame, baseline_moments: DataFrame, baseline_histogram: DataFrame,
    threshold: float = KL_THRESHOLD, min_rows: int = MIN_ROWS, by: Sequence[str] = (),
) -> DataFrame:
    """Drift flag and mean shift per feature with enough values, from ``binned_counts``."""
    shares = F.sort_array(F.collect_list(F.struct("bin", "share")))
    baseline = bounded_side(
        baseline_histogram.groupBy("feature").agg(shares["share"].alias("_q"))
        .join(baseline_moments.select("feature", F.col("mean").alias("baseline_mean")), "feature")
    )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    known = F.greatest(total(F.col("counts")), F.lit(1.0))
    with_shares = (
        counts.filter(F.col("rows") >= min_rows).join(baseline, "feature")
        .withColumn("_p", F.transform("counts", lambda c: c / known + EPSILON))
        .withColumn("_q", F.transform("_q", lambda q: q + EPSILON))
    )
    # sum p' ln(p'/q') with p' = p/P, q' = q/Q  =  sum(p ln(p/q))/P + ln(Q/P)
    apart = total(F.zip_with("_p", "_q", lambda p, q: p * F.ln(p / q)))
    kl = apart / total(F.col("_p")) + F.ln(total(F.col("_q")) / total(F.col("_p")))
    return with_shares.withColumn("_kl", kl).select(
        *by,
        "feature",
        rounded(F.col("_kl"), 6).alias("kl_divergence"),
        (F.col("_kl") > threshold).alias("is_drifted"),
        "recent_mean",
        "baseline_mean",
        rounded(F.col("recent_mean") - F.col("baseline_mean"), 4).alias("mean_shift"),
    )


def drift_report(
    recent: DataFrame, baseline_moments: DataFrame, baseline_histogram: DataFrame,
    threshold: float = KL_THRESHOLD, min_rows: int = MIN_ROWS, bins: int = BINS,
) -> DataFrame:
    """Drift flag and mean shift per feature that has enough recent values; one scan of them."""
    counts = binned_counts(recent, baseline_histogram, (), bins)
    return report_of(counts, baseline_moments, baseline_histogram, threshold, min_rows)


def drift_summary(report: DataFrame) -> DataFrame:
    """One row: features checked, sorted drifted features, any drift."""
    return report.agg(
        F.count("*").alias("total_features_checked"),
        F.sort_array(F.collect_list(F.when(F.col("is_drifted"), F.col("feature")))).alias(
            "drifted_features"
        ),
    ).withColumn("drift_detected", F.size("drifted_features") > 0)


def label_drift(recent: DataFrame, baseline: DataFrame, label: str) -> DataFrame:
    """KL of label shares: one row with the divergence, flag and number of labels."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(label).agg(F.count("*").alias(name))

    both = shares(recent, "_r").join(shares(baseline, "_b"), label, "full").na.fill(0)
    recent_rows, baseline_rows = both.agg(F.sum("_r"), F.sum("_b")).first()
    p = F.col("_r") / F.lit(float(recent_rows or 1)) + EPSILON
    q = F.col("_b") / F.lit(float(baseline_rows or 1)) + EPSILON
    sums = both.agg(
        F.count("*").alias("labels"),
        F.sum(p * F.ln(p / q)).alias("_s"),
        F.sum(p).alias("_tp"),
        F.sum(q).alias("_tq"),
    )
    kl = F.col("_s") / F.col("_tp") + F.ln(F.col("_tq") / F.col("_tp"))
    return sums.select(
        "labels",
        rounded(kl, 6).alias("kl_divergence"),
        (kl > KL_THRESHOLD).alias("is_drifted"),
    )


def outliers_iqr(long: DataFrame, k: float = 1.5) -> DataFrame:
    """Per feature: the fences p25 - k*IQR and p75 + k*IQR and the rows outside them."""
    known = long.filter("value IS NOT NULL")
    quartiles = exact_quantiles(
        known, ["feature"], "value", [0.25, 0.75], ["p25", "p75"]
    )
    spread = F.col("p75") - F.col("p25")
    fences = quartiles.select(
        "feature",
        (F.col("p25") - k * spread).alias("lower_fence"),
        (F.col("p75") + k * spread).alias("upper_fence"),
    )
    value = F.col("value")
    return (
        null_safe(known, bounded_side(fences), ["feature"])
        .groupBy("feature", "lower_fence", "upper_fence")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(
                (value < F.col("lower_fence")) | (value > F.col("upper_fence"))
            ).alias("outliers"),
        )
    )
