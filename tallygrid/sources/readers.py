"""Scans: Parquet, captured JSON lines, result CSV, document folders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NOT_SPACE
from ..schemas import require_columns


def read_gold(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A gold table with checked column names and types."""
    return require_columns(spark.read.parquet(path), schema)


def read_parquet_parts(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files under a folder as one frame; none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    if not files.load(folder).select("path").head(1):
        raise FileNotFoundError(f"No parquet files found in {folder}")
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Frames with the same columns, in any order, one after the other."""
    if not parts:
        raise ValueError("nothing to unite")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@dataclass(frozen=True)
class Capture:
    """Captured rows, the lines that are none, and how many there were of each.

    The counts are taken in the pass that first reads ``rows``.
    """

    rows: DataFrame
    bad: DataFrame
    seen: Observation
    lines: DataFrame

    def counts(self) -> dict[str, int]:
        """``lines`` in the window, ``bad_lines`` among them and ``good_lines``.

        Call it after ``rows`` have been read.  A query that turned out to be empty on its way
        may have dropped the counting step with the rest; then the lines are counted here.
        """
        try:
            found = self.seen.get
        except Py4JJavaError:
            found = self.lines.agg(*_line_counts()).first().asDict()
        return {k: int(v or 0) for k, v in found.items()}


def _line_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("lines"), F.count_if("_is_bad").alias("bad_lines"),
            F.count_if(~F.col("_is_bad")).alias("good_lines")]


def read_capture_window(
    spark: SparkSession, path: str, schema: T.StructType, since: str | None = None,
    until: str | None = None, ts: str = "ts", day: str = "date",
) -> Capture:
    """Captured JSON lines with ``since <= ts < until``; lines that do not parse are kept aside.

    Folders named ``date=2024-01-31`` below ``path`` are discovered, and those outside of the
    window are neither listed further nor read; a row lies in the folder of its day.  Without
    such folders all files are read.  A line that is no JSON object of ``schema`` is bad; it
    keeps its file and, where there are day folders, its day.  Blank lines are no lines.
    """
    lines = spark.read.text(path)
    dated = day in lines.columns
    ends = [(F.lit(v).cast("timestamp"), sign) for v, sign in ((since, 1), (until, -1)) if v]
    if dated:
        for moment, sign in ends:
            edge = F.to_date(moment if sign > 0 else moment - F.expr("INTERVAL 1 MICROSECOND"))
            lines = lines.filter(F.col(day) >= edge if sign > 0 else F.col(day) <= edge)
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    place = F.col(day).cast("date") if dated else F.lit(None).cast("date")
    parsed = lines.filter(F.trim("value") != "").select(
        F.from_json("value", marked, options).alias("_row"), F.col("value").alias("line"),
        place.alias("_day"), F.col("_metadata.file_path").alias("file"),
    )
    bad = F.col("_row").isNull() | F.col("_row._bad").isNotNull()
    inside = F.lit(True)
    for moment, sign in ends:
        at = F.col(f"_row.`{ts}`").cast("timestamp")
        inside = inside & (at >= moment if sign > 0 else at < moment)
    judged = parsed.select("*", bad.alias("_is_bad")).filter(F.col("_is_bad") | inside)
    seen = Observation()
    counted = judged.observe(seen, *_line_counts())
    rows = counted.filter(~F.col("_is_bad")).select(
        *[F.col(f"_row.`{f.name}`").alias(f.name) for f in schema.fields])
    bad_lines = judged.filter("_is_bad").select(F.col("_day").alias(day), "file", "line")
    return Capture(rows, bad_lines, seen, judged)


def capture_json(
    spark: SparkSession, path: str, schema: T.StructType, since: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """The rows of ``read_capture_window``."""
    return read_capture_window(spark, path, schema, since, ts=ts).rows


def days_before(now: Column, days: int) -> Column:
    """Cutoff of a capture window."""
    return now - F.make_interval(days=F.lit(days))


def parse_capture(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """A JSON text column as struct column ``payload``; rows that do not parse are dropped."""
    with_mark = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = df.withColumn("payload", F.from_json(column, with_mark, options))
    good = parsed.filter(F.col("payload").isNotNull() & F.col("payload._bad").isNull())
    return good.withColumn("payload", F.col("payload").dropFields("_bad"))


def read_result_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result set saved as CSV; the schema keeps codes such as "01001" strings."""
    return spark.read.option("header", True).schema(schema).csv(path)


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns whose every value is a number become doubles; "" becomes NULL.

    One pass decides for all columns.
    """
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not columns:
        return df

    def filled(c: str) -> Column:
        return F.when(F.trim(c) != "", F.col(c))

    row = df.agg(
        *[
            (F.count(filled(c)) == F.count(filled(c).try_cast("double"))).alias(c)
            for c in columns
        ]
    ).first()
    return df.withColumns(
        {
            c: filled(c).try_cast("double") if row[c] else filled(c)
            for c in columns
        }
    )


def read_corpus(
    spark: SparkSession, folder: str, extensions: Sequence[str] = (".txt", ".md")
) -> DataFrame:
    """``(source, text)`` of every text file below a folder, one row per file.

    Bytes that are not UTF-8 become U+FFFD; files with white space only are skipped.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    )
    wanted = F.lit(False)
    for extension in extensions:
        wanted = wanted | F.lower("path").endswith(extension)
    return (
        files.filter(wanted)
        .select(F.col("path").alias("source"), F.col("content").cast("string").alias("text"))
        .filter(F.col("text").rlike(NOT_SPACE))
    )
