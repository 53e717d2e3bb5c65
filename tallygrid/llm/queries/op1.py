"""Fixity audit of all pages as archive records.

The supplied pages are one copy without files or offsets.  They are laid out in archive files
of 4096 page ids, one record (a short header and the page) after the other.  The second copy
is derived by a stated rule of damage: of the pages whose id's checksum is 0 modulo 61 one
character changed, of those with 1 the record is lost, of those with 2 the page is cut.

Defined cases: a page without an id takes the checksum of its URL, which also names its file,
so that such pages do not meet in one; rows that repeat an id lie one after the other in the
order of their digests, each a record of its own (a window sorts a file's sizes and digests,
which spill); a NULL URL or page is an empty one; no pages give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import stored
from ..merkle import audit, content_digest, records

PER_FILE = 4096
NAMELESS = -(1 << 52)  # below the number of every file of page ids


def _record(html: Column) -> Column:
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")), F.lit("\r\n\r\n"), F.coalesce(html, F.lit("")),
    )


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = F.coalesce(F.col("page_id").cast("string"), "url", F.lit(""))
    digits = F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("bigint")
    check = digits % 61
    html = F.col("html")
    damaged = F.when(
        check == 0, F.concat(F.substring(html, 1, 10), F.lit("?"), F.expr("substr(html, 12)"))
    ).when(check == 2, F.substring(html, 1, 20)).otherwise(html)
    # Only digests and lengths are placed, never the pages, and every row just once.
    slim = pages.select(
        "page_id",
        F.when(F.col("page_id").isNull(), F.lit(NAMELESS) - digits)
        .otherwise(F.floor(F.col("page_id") / PER_FILE)).cast("bigint").alias("archive"),
        F.octet_length(_record(html)).cast("bigint").alias("bytes"),
        content_digest(_record(html)).alias("content"),
        (check != 1).alias("copied"),
        F.octet_length(_record(damaged)).cast("bigint").alias("other_bytes"),
        content_digest(_record(damaged)).alias("other_content"),
    )
    before = Window.partitionBy("archive").orderBy("page_id", "content", "other_content"
                                                   ).rowsBetween(Window.unboundedPreceding, -1)
    laid = stored(slim.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0))))

    def leaves(rows: DataFrame, size: str, content: str) -> DataFrame:
        return records(rows, F.col("archive"), F.col("offset"), F.col(size), F.col(content))

    return audit(leaves(laid, "bytes", "content"),
                 leaves(laid.filter("copied"), "other_bytes", "other_content"))


QUERIES = {"op1_merkle_fixity": op1_merkle_fixity}
ORACLES = {
    "op1_merkle_fixity": r"""
WITH laid AS (
  SELECT *, CASE WHEN page_id IS NULL THEN -4503599627370496 - digits
                 ELSE page_id // 4096 END AS archive, digits % 61 AS mark
  FROM (SELECT page_id, html,
         'WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: ' || coalesce(url, '') AS head,
         ('0x' || substr(md5(coalesce(page_id::VARCHAR, url, '')), 1, 7))::BIGINT AS digits
  FROM pages)),
copies AS (
  SELECT page_id, archive, mark, head || '\r\n\r\n' || coalesce(html, '') AS r,
         head || '\r\n\r\n' || coalesce(CASE mark
           WHEN 0 THEN substr(html, 1, 10) || '?' || substr(html, 12)
           WHEN 2 THEN substr(html, 1, 20) ELSE html END, '') AS r2
  FROM laid),
placed AS (
  SELECT *, coalesce(sum(strlen(r)) OVER (PARTITION BY archive
         ORDER BY page_id, sha256(r), sha256(r2) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o
  FROM copies)
SELECT archive, o AS "offset", strlen(r) AS length,
       CASE WHEN mark <> 1 THEN strlen(r2) END AS other_length,
       sha256(archive || '|' || o || '|' || sha256(r)) AS digest,
       CASE WHEN mark <> 1 THEN sha256(archive || '|' || o || '|' || sha256(r2)) END AS other_digest,
       CASE WHEN mark = 1 THEN 'missing' ELSE 'changed' END AS fault
FROM placed WHERE mark = 1 OR r <> r2
""".replace(r"\r\n", "' || chr(13) || chr(10) || '")
}
