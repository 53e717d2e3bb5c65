"""Exact order statistics, quantiles and global ranks without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sizing import bounded_side

# Rank error of the sketch that brackets a target is at most n / ACCURACY.
ACCURACY = 10_000
# A bracket that may hold more rows than this is narrowed by a second sketch inside it.
BRACKET_ROWS = 1_000_000
# Rows that a global rank samples for its range bounds.
PER_RANGE = 64
BOUND_ROWS = 20_000

Position = Callable[[Column, float], Column]


def _linear_position(n: Column, p: float) -> Column:
    return F.lit(p) * (n - 1)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the left side's keys are kept."""
    if not keys:
        return left.join(right, how=how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def order_statistics(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float],
    position: Position = _linear_position,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``(groups…, target, n, statistic)``: the value at 0-based rank ``position(n, probs[target])``.

    Fractional positions interpolate linearly.  NULL values are ignored; a NULL group is a
    group like any other, and a group without values has a NULL statistic.  A quantile sketch
    first brackets every target to about ``10 n / accuracy`` rows (its rank error is
    guaranteed, so the bracket holds the target); a second pass counts the rows below the
    bracket and the distinct values inside it.  Only those few values are ordered, so a group
    holding most of the table stays spread out.  There is one way for inputs of all sizes;
    brackets of more than ``BRACKET_ROWS`` rows are narrowed once more.
    """
    keys = list(groups)
    data = df.select(*keys, F.col(value).cast("double").alias("_v"))
    margin = 5.0 / accuracy
    none = F.lit(None).cast("double")
    cuts = [max(p - margin, 0.0) for p in probs] + [min(p + margin, 1.0) for p in probs]
    sketch = data.groupBy(*keys).agg(
        F.count("_v").alias("n"), F.percentile_approx("_v", cuts, accuracy).alias("_cuts")
    )
    targets = []
    for index, p in enumerate(probs):
        wide = F.col("n") > accuracy
        low = F.when(wide, F.col("_cuts")[index]) if p - margin > 0 else none
        high = F.when(wide, F.col("_cuts")[len(probs) + index]) if p + margin < 1 else none
        targets.append(
            F.struct(
                F.lit(index).alias("target"),
                position(F.col("n"), p).cast("double").alias("_pos"),
                low.alias("_low"),
                high.alias("_high"),
            )
        )
    brackets = bounded_side(sketch.select(*keys, "n", F.inline(F.array(*targets))))
    wanted = brackets.filter("n > 0 AND _pos >= 0")
    if (brackets.agg(F.max("n")).first()[0] or 0) > BRACKET_ROWS * accuracy // 10:
        wanted = _narrowed(data, wanted, keys, accuracy)

    inside = F.col("_low").isNull() | (F.col("_v") >= F.col("_low"))
    near = _beside(data.filter("_v IS NOT NULL"), wanted, keys).filter(
        "_high IS NULL OR _v <= _high"
    )
    counted = near.groupBy(
        *keys, "target", "n", "_pos", F.when(inside, F.col("_v")).alias("_key")
    ).agg(F.count("*").alias("_count"))
    ordered = (
        Window.partitionBy(*keys, "target")
        .orderBy(F.col("_key").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = counted.withColumn("_cum", F.sum("_count").over(ordered))
    known = F.col("_key").isNotNull()
    found = running.groupBy(*keys, "target", "n", "_pos").agg(
        F.min(F.when(known & (F.col("_cum") > F.floor("_pos")), F.col("_key"))).alias("_a"),
        F.min(F.when(known & (F.col("_cum") > F.ceil("_pos")), F.col("_key"))).alias("_b"),
    )
    part = F.col("_pos") - F.floor("_pos")
    statistic = F.when(part == 0, F.col("_a")).otherwise(
        (1 - part) * F.col("_a") + part * F.col("_b")
    )
    empty = brackets.filter("n = 0").select(*keys, "target", "n", none.alias("statistic"))
    return found.select(*keys, "target", "n", statistic.alias("statistic")).unionByName(empty)


def _narrowed(
    data: DataFrame, wanted: DataFrame, keys: Sequence[str], accuracy: int
) -> DataFrame:
    """The same targets with brackets cut once more, by a sketch of what lies inside each."""
    near = _beside(data.filter("_v IS NOT NULL"), wanted, keys)
    inside = (F.col("_low").isNull() | (F.col("_v") >= F.col("_low"))) & (
        F.col("_high").isNull() | (F.col("_v") <= F.col("_high"))
    )
    counts = near.groupBy(*keys, "target", "n", "_pos", "_low", "_high").agg(
        F.count_if(F.col("_v") < F.col("_low")).alias("_below"),
        F.count_if(inside).alias("_inside"),
        F.percentile_approx(
            F.when(inside, F.col("_v")), [i / 1000 for i in range(1001)], accuracy
        ).alias("_grid"),
    )
    # Where the target's neighbours lie among the rows inside, in thousandths; the error of
    # the sketch takes one, or more if it is coarser.
    room = 1 + 1000.0 / accuracy
    part = F.lit(1000.0) / F.greatest(F.col("_inside"), F.lit(1))
    before = F.coalesce("_below", F.lit(0))
    low = F.floor((F.floor("_pos") - before) * part - room).cast("int")
    high = F.ceil((F.ceil("_pos") + 1 - before) * part + room).cast("int")
    return bounded_side(counts.select(
        *keys, "n", "target", "_pos",
        F.when(low < 0, F.col("_low")).otherwise(F.get("_grid", low)).alias("_low"),
        F.when(high > 1000, F.col("_high")).otherwise(F.get("_grid", high)).alias("_high"),
    ))


def _beside(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beside the side's rows of their group, or beside all of them without groups."""
    return null_safe(df, side, keys) if keys else _with_rows(df, side)


def _with_rows(df: DataFrame, side: DataFrame) -> DataFrame:
    """Every row beside each row of a one-per-target side, written as literals."""
    rows = side.collect()
    if not rows:
        return df.withColumns(
            {f.name: F.lit(None).cast(f.dataType) for f in side.schema}
        ).filter(F.lit(False))
    literals = [
        F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in side.schema])
        for r in rows
    ]
    return df.select("*", F.inline(F.array(*literals)))


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
) -> DataFrame:
    """One row per group with the linearly interpolated quantiles as columns ``names``.

    Groups without values have NULLs.
    """
    stats = order_statistics(df, groups, value, probs)
    columns = [
        F.max(F.when(F.col("target") == i, F.col("statistic"))).alias(n)
        for i, n in enumerate(names)
    ]
    return stats.groupBy(*groups).agg(*columns)


def _literal(value, kind: str) -> str:
    """A value as SQL text that no content can break out of."""
    if value is None:
        return f"CAST(NULL AS {kind})"
    text = repr(value) if isinstance(value, float) else str(value)
    raw = bytes(value) if isinstance(value, (bytes, bytearray)) else text.encode("utf-8")
    return f"CAST(CAST(X'{raw.hex()}' AS STRING) AS {kind})"


def _ranges(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with ``_part``, the number of its range of the ascending order ``by``.

    Bounds are literals from ``PER_RANGE`` rows a range, ``BOUND_ROWS`` at most, those with the
    smallest hashes, found in one pass.  They are part of the plan, so a lost executor cannot change them, and decide only
    where rows are worked on.  A row finds its range by halving: as many steps as the logarithm
    of their number.
    """
    order = F.struct(*by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = df.select(*by).orderBy(F.xxhash64(*by)).limit(min(BOUND_ROWS, PER_RANGE * parts))
    sample = chosen.distinct().orderBy(*by).collect()
    step = max(1, len(sample) // parts)
    rows = sample[step::step]
    if not rows:
        return df.withColumn("_part", F.lit(0))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    texts = ", ".join(
        "struct(" + ", ".join(f"{_literal(r[c], types[c])} AS `{c}`" for c in by) + ")"
        for r in rows)
    bounds = F.expr(f"array({texts})")

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.floor((low + high) / 2).cast("int")
        above = (low < high) & (F.get(bounds, middle) < order)
        return F.struct(
            F.when(above, middle + 1).otherwise(low).alias("low"),
            F.when(above, high).otherwise(F.least(middle, high)).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(rows).bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(rows)).alias("high"))
    return df.withColumn("_part", F.aggregate(steps, start, halve, lambda s: s["low"]))


def running_total(
    df: DataFrame, by: Sequence[str], weight: str, name: str, total: str | None = None
) -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows before each in the total order ``by``.

    ``total`` names a column for the sum over all rows.  Rows are cut into ranges, summed per
    range, and added up inside their range.
    """
    placed = _ranges(df, by)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    offsets = (
        placed.groupBy("_part")
        .agg(F.sum(weight).alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
                F.sum("_sum").over(Window.partitionBy(F.lit(0))).alias("_total"))
    )
    before = (
        Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    )
    added = placed.join(F.broadcast(offsets), "_part").withColumn(
        name, F.coalesce(F.sum(weight).over(before), F.lit(0)) + F.col("_offset"))
    if total:
        added = added.withColumn(total, F.col("_total"))
    return added.drop("_part", "_offset", "_total")


def global_rank(df: DataFrame, by: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank over the whole frame by ``by``, ascending, NULLs first.

    ``by`` must order the rows totally.
    """
    counted = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), by, "_one", "_before")
    return counted.withColumn(name, F.col("_before") + 1).drop("_one", "_before")
