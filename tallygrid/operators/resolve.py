"""Entity lookup by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import bounded_rows
from ..schemas import Names

# Up to this many distinct lookups travel to the entities before these are shuffled.
ASKED_ROWS = 50_000

# Rank of a match: exact name, exact after hyphens became blanks, prefix.
EXACT, EXACT_SPACED, PREFIX = 0, 1, 2


def clean_name(name: Column, chars: int | None = None) -> Column:
    """Letters, digits, blanks and hyphens only, trimmed, in lower case, cut if asked.

    Asked names and entities' names are cleaned alike, so dots and apostrophes never decide.
    """
    letters = F.lower(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} \-]", "")))
    return F.substring(letters, 1, chars) if chars else letters


def _prefix_index(
    entity: DataFrame, wanted: DataFrame, names: Names, chars: int | None
) -> DataFrame:
    """Best candidate per (name prefix, group hint); hint "" stands for any group.

    Prefix lookup becomes an equi-join: a name yields its prefixes, and candidates collapse
    to one per prefix before the join, map-side first.  If few prefixes are asked for, all
    others are dropped where they arise.
    """
    lower = clean_name(F.col(names.name), chars)
    lengths = F.sequence(F.lit(1), F.length(lower))
    rows = (
        entity.filter(F.length(lower) > 0)
        .withColumn("_length", F.explode(lengths))
        .select(
            F.substring(lower, F.lit(1), F.col("_length")).alias("_prefix"),
            F.explode(F.array(F.lit(""), F.lower(F.coalesce(names.group, F.lit(""))))).alias(
                "_hint"
            ),
            F.struct(
                F.when(F.col("_length") == F.length(lower), 0).otherwise(1).alias("partial"),
                F.col(names.entity).alias("entity"),
                F.col(names.name).alias("name"),
                F.col(names.group).alias("group"),
            ).alias("_candidate"),
        )
    )
    asked = bounded_rows(wanted.select("_prefix", "_hint").distinct(), ASKED_ROWS)
    if asked is not None:
        rows = rows.join(asked, ["_prefix", "_hint"], "left_semi")
    return rows.groupBy("_prefix", "_hint").agg(F.min("_candidate").alias("_candidate"))


def resolve_entity(
    lookups: DataFrame, entity: DataFrame, key: str = "lookup_id", name: str = "name",
    hint: str | None = None, names: Names = Names(), chars: int | None = None,
) -> DataFrame:
    """Best entity per looked-up name: exact before hyphen variant before prefix.

    ``hint`` names a column with an optional group to narrow to.  Ties go to the
    smallest entity id.  Names without a match are left out.
    """
    cleaned = clean_name(F.col(name), chars)
    group = F.lower(F.trim(F.col(hint))) if hint else F.lit("")
    wanted = (
        lookups.select(
            key,
            cleaned.alias("_plain"),
            F.replace(cleaned, F.lit("-"), F.lit(" ")).alias("_spaced"),
            F.coalesce(group, F.lit("")).alias("_hint"),
        )
        .filter("_plain <> ''")
        .select(
            key,
            "_hint",
            F.inline(
                F.array(
                    F.struct(F.col("_plain").alias("_prefix"), F.lit(EXACT).alias("_variant")),
                    F.struct(
                        F.col("_spaced").alias("_prefix"), F.lit(EXACT_SPACED).alias("_variant")
                    ),
                )
            ),
        )
    )
    candidate = F.col("_candidate")
    priority = F.when(candidate["partial"] == 0, F.col("_variant")).otherwise(F.lit(PREFIX))
    best = (
        wanted.join(_prefix_index(entity, wanted, names, chars), ["_prefix", "_hint"])
        .groupBy(key)
        .agg(
            F.min(
                F.struct(
                    priority.alias("priority"),
                    candidate["entity"].alias("entity"),
                    candidate["name"].alias("name"),
                    candidate["group"].alias("group"),
                )
            ).alias("_best")
        )
    )
    return best.select(
        key,
        F.col("_best.entity").alias(names.entity),
        F.col("_best.name").alias(names.name),
        F.col("_best.group").alias(names.group),
        F.col("_best.priority").alias("priority"),
    )


def ambiguous_names(
    entity: DataFrame, limit: int | None = None, names: Names = Names()
) -> DataFrame:
    """Names that occur in more than one group, with all groups or the first ``limit``.

    The full number of groups is counted beside the listing.
    """
    pairs = entity.select(F.lower(names.name).alias("name"), F.col(names.group).alias("_group"))
    pairs = pairs.distinct()
    many = pairs.groupBy("name").agg(F.count("*").alias("group_count")).filter("group_count > 1")
    groups = F.sort_array(F.collect_set("_group"))
    listed = pairs.groupBy("name").agg(
        (F.slice(groups, 1, limit) if limit else groups).alias("groups")
    )
    return many.join(listed, "name").select("name", "group_count", "groups")
