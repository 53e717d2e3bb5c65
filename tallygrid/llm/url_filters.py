"""Temporal URL lists: every capture is judged by the entries active when it was fetched.

A list is a log of dated changes: an entry (a host, a domain with all below it, or one URL)
is added to or removed from a named list.  ``validity`` turns the log into intervals, from a
change to the next change of the same entry.  ``judge`` looks up each capture under its URL,
its host and every parent domain of it, and keeps the entries whose interval holds the fetch
time: an as-of join, where a capture meets at most one interval per list and key.

Captures of one hot host need not meet in one task: intervals are first folded to one row
per key, and the join is a plain equi-join on the key, which Spark broadcasts by size or
splits where it is skewed.

Defined cases: a NULL or empty URL has no keys and is not blocked; a URL without a host has
only itself as key; a NULL time lies in no interval; changes with a NULL list, key, kind or
time say nothing; of changes of one entry at the same time the removal wins; repeated changes
count once; repeated captures are judged each; empty inputs give all captures unblocked or no
rows; extra columns of the captures pass, the result's own names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import unused

HOST, DOMAIN, URL = "host", "domain", "url"
RESULT = ("blocked", "n_entries", "lists", "first_match")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dot."""
    host = F.lower(
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+?)\.?(?:[:/?#]|$)", 1)
    )
    return F.when(host != "", host)


def plain_url(url: Column) -> Column:
    """The URL without scheme, query and fragment, and without a slash at the end."""
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", ""),
        r"/+$", "",
    )


def lookup_keys(url: Column) -> Column:
    """``kind:key`` strings under which a list may name the URL."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.when(
        host.isNotNull(),
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda k: F.concat(
                F.lit(f"{DOMAIN}:"),
                F.array_join(F.slice(labels, k, F.size(labels)), "."),
            ),
        ),
    )
    own = F.when(url.isNotNull() & (url != ""), F.concat(F.lit(f"{URL}:"), plain_url(url)))
    return F.array_distinct(
        F.array_compact(
            F.concat(
                F.array(own, F.concat(F.lit(f"{HOST}:"), host)),
                F.coalesce(domains, F.array().cast("array<string>")),
            )
        )
    )


def validity(changes: DataFrame) -> DataFrame:
    """``(key, list, since, until)`` from changes ``(list, kind, key, at, added)``.

    ``until`` is NULL while the entry stands.  Times are half open.
    """
    named = (
        changes.filter("list IS NOT NULL AND kind IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL")
        .groupBy("list", F.concat_ws(":", "kind", "key").alias("key"), "at")
        .agg(F.min(F.coalesce("added", F.lit(False))).alias("added"))
    )
    entry = Window.partitionBy("list", "key").orderBy("at")
    return (
        named.withColumn("_was", F.lag("added", 1, False).over(entry))
        .filter(F.col("added") != F.col("_was"))
        .withColumn("until", F.lead("at").over(entry))
        .filter("added")
        .select("key", "list", F.col("at").alias("since"), "until")
    )


def judge(captures: DataFrame, intervals: DataFrame, url: str = "url", at: str = "fetched_at"
          ) -> DataFrame:
    """``captures`` with ``blocked``, ``n_entries``, ``lists`` and ``first_match``."""
    rows = captures.drop(*RESULT)
    asked_url, asked_at = unused(rows, "_url", "_at")
    by_key = intervals.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("list", "since", "until"))).alias("_spans")
    )
    fields = [F.col(c) for c in rows.columns]
    # Distinct (URL, time) pairs are looked up, so repeated captures share their lookups.
    asked = (
        rows.select(F.col(url).alias(asked_url), F.col(at).alias(asked_at)).distinct()
        .select(asked_url, asked_at, F.explode(lookup_keys(F.col(asked_url))).alias("key"))
    )
    active = asked.join(by_key, "key").select(
        asked_url, asked_at, "key",
        F.filter(
            "_spans",
            lambda s: (s["since"] <= F.col(asked_at))
            & (s["until"].isNull() | (F.col(asked_at) < s["until"])),
        ).alias("_spans"),
    ).filter(F.size("_spans") > 0)
    found = active.groupBy(asked_url, asked_at).agg(
        F.sum(F.size("_spans")).cast("bigint").alias("n_entries"),
        F.array_join(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(
                F.transform("_spans", lambda s: s["list"]))))), ",",
        ).alias("lists"),
        F.min(F.struct(F.col("_spans")[0]["since"], F.col("key")))["key"].alias("first_match"),
    )
    joined = rows.join(
        found, F.col(url).eqNullSafe(F.col(asked_url)) & F.col(at).eqNullSafe(F.col(asked_at)), "left"
    )
    return joined.select(
        *fields,
        F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        "first_match",
    )
