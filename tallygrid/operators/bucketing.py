"""Target tiers, stratified splits and folds.

Strata and tiers hold a large share of the table each, so nothing here sorts a
stratum: cut points are exact order statistics, and rows compare against them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.selection import exact_quantiles, null_safe, order_statistics, running_total
from ..functions.sizing import bounded_side
from .features import LABELS


def tier_edges(df: DataFrame, column: str, tiers: int = 3) -> list[float]:
    """The inner quantile edges of a column; one row reaches the driver."""
    probs = [i / tiers for i in range(1, tiers)]
    names = [f"edge{i}" for i in range(1, tiers)]
    rows = exact_quantiles(df, [], column, probs, names).collect()
    return list(rows[0]) if rows else []


def tertile_bucket(
    df: DataFrame, column: str, key: str, labels: Sequence[str] = LABELS,
    name: str = "risk_bucket",
) -> DataFrame:
    """Label rows by quantile of ``column``: right-closed bins, lowest value included.

    When ties make quantile edges coincide, bins cannot be told apart by value; rows are
    then cut by rank instead (see ``tertile_by_rank``).
    """
    row = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if row is None or row[0] is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    edges = [row[0], *tier_edges(df, column, len(labels)), row[1]]
    if len(set(edges)) < len(edges):
        return tertile_by_rank(df, column, key, labels, name)
    value = F.col(column).cast("double")
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:-1], labels, strict=False):
        chain = chain.when(value <= F.lit(edge), label)
    return df.withColumn(name, chain.otherwise(labels[-1]))


def tertile_by_rank(
    df: DataFrame, column: str, key: str, labels: Sequence[str] = LABELS,
    name: str = "risk_bucket",
) -> DataFrame:
    """Label rows by equal-width bins of their rank; ties are ranked by ``key``.

    Rows without a value come first in the order, weigh nothing and get no label.
    """
    weighed = df.withColumn("_valued", F.col(column).isNotNull().cast("bigint"))
    ranked = running_total(weighed, [column, key], "_valued", "_before", "_n")
    before, n, width = F.col("_before"), F.col("_n"), len(labels)
    chain = F.when(F.col("_valued") == 0, F.lit(None).cast("string"))
    for i, label in enumerate(labels[:-1], start=1):
        # rank <= 1 + i * (n - 1) / width, in whole numbers
        chain = chain.when(before * width <= i * (n - 1), label)
    return ranked.withColumn(name, chain.otherwise(labels[-1])).drop("_valued", "_before", "_n")


Hasher = Callable[[Column, str], Column]


def fast_hash(key: Column, salt: str) -> Column:
    """52 pseudo-random bits of ``key``, exact in a double."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), key), 12)


def portable_hash(key: Column, salt: str) -> Column:
    """The same from MD5: many times slower, but any engine can repeat it."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def _cut_points(
    df: DataFrame, stratum: str, key: Column, probs: Sequence[float], position
) -> tuple[DataFrame, DataFrame]:
    hashed = df.withColumn("_hash", key)
    cuts = order_statistics(hashed, [stratum], "_hash", probs, position)
    per_stratum = cuts.groupBy(stratum).agg(
        *[
            F.max(F.when(F.col("target") == i, F.col("statistic"))).alias(f"_cut{i}")
            for i in range(len(probs))
        ]
    )
    return hashed, bounded_side(per_stratum)


def stratified_split(
    df: DataFrame, stratum: str, key: str, ratio: float = 0.8, seed: int = 42,
    name: str = "is_train", hasher: Hasher = fast_hash,
) -> DataFrame:
    """Exactly ``round(ratio * n)`` rows of each stratum become training rows.

    Rows without a stratum are a stratum of their own.

    The choice depends on the key and seed only, so it survives recomputation.
    """

    def last_train_row(n: Column, p: float) -> Column:
        return F.floor(n * F.lit(p) + F.lit(0.5)) - 1

    hashed, cuts = _cut_points(
        df, stratum, hasher(F.col(key), f"{seed}:"), [ratio], last_train_row
    )
    chosen = F.coalesce(F.col("_hash") <= F.col("_cut0"), F.lit(False))
    return (
        null_safe(hashed, cuts, [stratum], "left").withColumn(name, chosen).drop("_hash", "_cut0")
    )


def stratified_folds(
    df: DataFrame, stratum: str, key: str, k: int = 5, seed: int = 42, name: str = "fold",
    hasher: Hasher = fast_hash,
) -> DataFrame:
    """Fold 0..k-1 per row; every fold holds its share of each stratum within one row.

    Folds are independent of a split with the same seed.
    """

    def last_row_of_fold(n: Column, p: float) -> Column:
        part = int(round(p * k))
        return F.floor((n * part + (k - 1)) / k) - 1

    probs = [i / k for i in range(1, k)]
    hashed, cuts = _cut_points(
        df, stratum, hasher(F.col(key), f"{seed}:fold:"), probs, last_row_of_fold
    )
    fold = F.lit(0)
    for i in range(len(probs)):
        cut = F.col(f"_cut{i}")
        fold = fold + F.when(cut.isNull() | (F.col("_hash") > cut), 1).otherwise(0)
    joined = null_safe(hashed, cuts, [stratum], "left").withColumn(name, fold)
    return joined.drop("_hash", *[f"_cut{i}" for i in range(len(probs))])
