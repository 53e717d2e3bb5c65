"""Size checks that decide between plan shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Inputs whose optimizer estimate (an upper bound for file scans) is below this are
# handled in one aggregation buffer; larger ones take the distributed way.
SMALL_BYTES = 64 * 1024 * 1024

# Row bound for model-sized side tables: features, strata, classes, thresholds.
SIDE_ROWS = 10_000


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan, in bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    return plan_bytes(df) <= limit


def spread(df: DataFrame, limit: int = 16 * SMALL_BYTES) -> DataFrame:
    """Even rows over all cores before per-row heavy work, if the input is small.

    A small file is often a single row group, which one task would read and process
    alone.  Large inputs have row groups to go round and are left as they lie.
    """
    if not is_small(df, limit):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def bounded_rows(df: DataFrame, max_rows: int = SIDE_ROWS) -> DataFrame | None:
    """The frame as a broadcast copy of at most ``max_rows`` rows; None if it has more."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def bounded_side(df: DataFrame, max_rows: int = SIDE_ROWS) -> DataFrame:
    """A join side that is broadcast if it really has at most ``max_rows`` rows.

    Above the bound the frame comes back unhinted, and the join shuffles.
    """
    small = bounded_rows(df, max_rows)
    return df if small is None else small
