"""The capture folder as a stream: ingest, daily statistics, drift, scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import drift
from ..operators.modeling import Model, batch_score
from ..sources.sinks import write_predictions


def read_capture(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1_000
) -> DataFrame:
    """New JSON-lines files of an append-only folder; malformed lines are dropped."""
    return (
        spark.readStream.schema(schema)
        .option("mode", "DROPMALFORMED")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )


def ingest_capture(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, appended to a Parquet table exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )


def daily_feature_stats(
    long: DataFrame, ts: str = "ts", delay: str = "1 day"
) -> DataFrame:
    """Rows, mean, min and max per feature and day, for a stream or a table.

    On a stream, days close ``delay`` after their end and later rows are dropped.
    """
    source = long.withWatermark(ts, delay) if long.isStreaming else long
    return (
        source.groupBy(F.window(ts, "1 day"), "feature")
        .agg(
            F.count("*").alias("rows"),
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        .withColumn("day", F.col("window.start"))
        .drop("window")
    )


def _each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str,
    mode: str = "append",
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_drift(
    stream: DataFrame, features: Sequence[str], moments_path: str, histogram_path: str,
    report_path: str, checkpoint: str, threshold: float = drift.KL_THRESHOLD,
    window: str | None = None, ts: str = "ts", delay: str = "1 day",
) -> StreamingQuery:
    """Drift of all that has arrived against the stored baseline, however it is cut into batches.

    Counts per feature and baseline bin are the state of the query, so a feature is checked as
    soon as all batches together have enough values.  Without ``window`` the report at
    ``report_path`` is replaced after every batch.  With one, such as "1 day", every window of
    ``ts`` gets one report, as soon as the watermark ``delay`` has passed its end; the state
    holds open windows only, and later rows are dropped.  Reports of closed windows are
    partitioned by batch, so a replayed batch replaces its own.
    """
    spark = stream.sparkSession
    moments, histogram = (spark.read.parquet(p) for p in (moments_path, histogram_path))
    if window is None:
        state = drift.binned_counts(drift.to_long(stream, features), histogram)
    else:
        timed = drift.to_long(stream.withWatermark(ts, delay), features, [ts])
        state = drift.binned_counts(timed, histogram, [F.window(ts, window).alias("window")])

    def report(counts: DataFrame, batch_id: int) -> None:
        by = [] if window is None else ["window"]
        found = drift.report_of(counts, moments, histogram, threshold, by=by)
        if window is None:
            found.write.mode("overwrite").parquet(report_path)
            return
        (
            found.withColumn("window_start", F.col("window.start")).drop("window")
            .withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch").parquet(report_path)
        )

    return _each_batch(state, report, checkpoint, "complete" if window is None else "append")


def stream_scores(
    stream: DataFrame, model: Model, keep: Sequence[str], path: str, model_name: str,
    checkpoint: str, run_date: str | None = None,
) -> StreamingQuery:
    """Scores of every micro-batch as a partition of its own."""

    def score(batch: DataFrame, batch_id: int) -> None:
        date = f"{run_date}-{batch_id}" if run_date else f"batch-{batch_id}"
        write_predictions(batch_score(model, batch, keep), path, date, model_name)

    return _each_batch(stream, score, checkpoint)
