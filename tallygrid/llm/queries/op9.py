"""Quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..quality_rules import BASE, ledger, mask_of, passes


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(mask_of(BASE))) != 0).alias("base_failed"),
        passes("v3").alias("kept"),
        "failures", "n_lines", "n_upper",
    )


# The ledger by ordinary SQL: windows are unnested and counted, bits added up.
MEASURED = r"""
d AS (
  SELECT *, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.* EXCLUDE (t, w, ls), len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_upper
  FROM d LEFT JOIN cov USING (doc_id)),
led AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
          + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
          + 8 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
          + 16 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
          + 32 * (100 * n_upper > 50 * word_chars)::BIGINT) AS failures
  FROM m)
"""

QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {
    "op9_quality_rules": f"""
WITH {MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures, n_lines, n_upper
FROM led
"""
}
