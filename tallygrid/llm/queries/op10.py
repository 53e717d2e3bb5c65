"""All pages judged by dated lists.

The supplied pages carry no fetch time and no list, so both are derived from them by stated
rules: page ``p`` was fetched ``p * 37 mod 365`` days into 2024.  Every third host (by the
checksum of its name) is on list ``hosts`` from a day of its own for 120 days, and again from
day 300; every fifth domain above a host is on list ``domains`` from a day of its own; one
URL in sixteen is on list ``urls`` from its day for 30 days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..url_filters import DOMAIN, HOST, URL, host_of, judge, plain_url, validity

START = "2024-01-01"


def _day(number) -> F.Column:
    return F.date_add(F.lit(START).cast("date"), number.cast("int"))


def _number(name: str) -> F.Column:
    """A number of an entry that SQL elsewhere computes alike."""
    return F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("int")


def _changes(keys: DataFrame, name: str, kind: str, *turns: tuple[int, bool]) -> DataFrame:
    """Turns are days after the entry's own day, each adding or removing it."""
    own = _number("key") % 200
    turn = [F.struct(_day(own + d).alias("at"), F.lit(added).alias("added")) for d, added in turns]
    return keys.select(
        F.lit(name).alias("list"), F.lit(kind).alias("kind"), "key", F.inline(F.array(*turn))
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _day(F.col("page_id") * 37 % 365))
    hosts = pages.select(host_of(F.col("url")).alias("key")).filter("key IS NOT NULL").distinct()
    domains = hosts.select(F.regexp_extract("key", r"^[^.]+\.(.+)$", 1).alias("key")).filter(
        "key <> ''").distinct()
    urls = pages.select(plain_url(F.col("url")).alias("key")).filter("key IS NOT NULL").distinct()
    changes = (
        _changes(hosts.filter(_number("key") % 3 == 0), "hosts", HOST,
                 (0, True), (120, False), (150, True))
        .unionByName(_changes(domains.filter(_number("key") % 5 == 0), "domains", DOMAIN, (0, True)))
        .unionByName(_changes(urls.filter(_number("key") % 16 == 0), "urls", URL,
                              (0, True), (30, False)))
    )
    return judge(captures, validity(changes)).select(
        "page_id", "fetched_at", "blocked", "n_entries", "lists", "first_match"
    )


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLES = {
    "op10_url_filters": r"""
WITH cap AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 365)::INT AS fetched_at,
         nullif(lower(regexp_extract(url,
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+?)\.?(?:[:/?#]|$)', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''),
           '[?#].*$', ''), '/+$', '') AS plain
  FROM pages),
hosts AS (SELECT DISTINCT host AS key FROM cap WHERE host IS NOT NULL),
entry AS (
  SELECT 'hosts' AS list, 'host:' || key AS key, ('0x' || substr(md5(key), 1, 7))::INT AS n FROM hosts
  UNION ALL
  SELECT DISTINCT 'domains', 'domain:' || d, ('0x' || substr(md5(d), 1, 7))::INT
  FROM (SELECT regexp_extract(key, '^[^.]+\.(.+)$', 1) AS d FROM hosts) WHERE d <> ''
  UNION ALL
  SELECT DISTINCT 'urls', 'url:' || plain, ('0x' || substr(md5(plain), 1, 7))::INT
  FROM cap WHERE plain IS NOT NULL),
span AS (
  SELECT list, key, DATE '2024-01-01' + (n % 200 + a) AS since,
         DATE '2024-01-01' + (n % 200 + b) AS until
  FROM entry, (VALUES ('hosts', 3, 0, 120), ('hosts', 3, 150, 100000), ('domains', 5, 0, 100000),
                      ('urls', 16, 0, 30)) AS t(l, m, a, b)
  WHERE list = l AND n % m = 0),
named AS (
  SELECT page_id, fetched_at, 'url:' || plain AS key FROM cap WHERE url <> ''
  UNION SELECT page_id, fetched_at, 'host:' || host FROM cap WHERE host IS NOT NULL
  UNION SELECT page_id, fetched_at,
               unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
                 lambda k: 'domain:' || array_to_string(string_split(host, '.')[k:], '.')))
  FROM cap WHERE host IS NOT NULL),
hit AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
         (min((since, key)))[2] AS first_match
  FROM named JOIN span USING (key) WHERE since <= fetched_at AND fetched_at < until
  GROUP BY page_id)
SELECT page_id, fetched_at, n IS NOT NULL AS blocked, coalesce(n, 0)::BIGINT AS n_entries,
       coalesce(lists, '') AS lists, first_match
FROM cap LEFT JOIN hit USING (page_id)
"""
}
