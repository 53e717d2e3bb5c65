"""Ranked reports: top entities by score or category, group totals.

All reports aggregate the fact table to one row per entity before they touch the
dimension, so the join sees entities, not facts, and the sort is a bounded top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mean, rounded
from ..functions.selection import running_total
from ..schemas import Names

ORDER_COLUMNS = ("total_events", "total_severe", "total_minor")


def in_years(names: Names, start: int, end: int) -> Column:
    return F.col(names.year).between(start, end)


def with_entity(df: DataFrame, entity: DataFrame, names: Names) -> DataFrame:
    """Inner join to the entity dimension; its size decides broadcast or shuffle."""
    return df.join(entity.select(names.entity, names.name, names.group), names.entity)


def _score_means(mart: DataFrame, start: int, end: int, names: Names) -> DataFrame:
    return (
        mart.filter(in_years(names, start, end))
        .groupBy(names.entity)
        .agg(
            mean(F.col(names.loss)).alias("_loss"),
            mean(F.col(names.risk)).alias("_risk"),
            mean(F.col(names.vulnerability)).alias("_vulnerability"),
            mean(F.col(names.resilience)).alias("_resilience"),
            F.count("*").alias("years_on_record"),
        )
    )


def _top_scores(scored: DataFrame, names: Names, places: int, limit: int) -> DataFrame:
    return (
        scored.select(
            names.entity,
            names.name,
            names.group,
            rounded(F.col("_loss"), places).alias("avg_loss_score"),
            rounded(F.col("_risk"), 4).alias("avg_risk_score"),
            rounded(F.col("_vulnerability"), 4).alias("avg_vulnerability"),
            rounded(F.col("_resilience"), 4).alias("avg_resilience"),
            "years_on_record",
        )
        .orderBy(F.desc_nulls_last("avg_loss_score"), names.entity)
        .limit(limit)
    )


def top_entities_by_score(
    mart: DataFrame, entity: DataFrame, start: int, end: int, limit: int = 20,
    names: Names = Names(),
) -> DataFrame:
    """Entities with the highest mean loss score over a year range."""
    scored = with_entity(_score_means(mart, start, end, names), entity, names)
    return _top_scores(scored, names, 2, limit)


def top_entities_in_group(
    mart: DataFrame, entity: DataFrame, group: str, start: int, end: int, limit: int = 20,
    names: Names = Names(),
) -> DataFrame:
    """Same, inside one group (case does not matter)."""
    members = entity.filter(F.lower(names.group) == group.strip().lower())
    facts = mart.join(members.select(names.entity), names.entity, "left_semi")
    scored = with_entity(_score_means(facts, start, end, names), members, names)
    return _top_scores(scored, names, 4, limit)


def entity_comparison(
    mart: DataFrame, entity: DataFrame, ids: Sequence, start: int, end: int, limit: int = 100,
    names: Names = Names(),
) -> DataFrame:
    """Yearly rows of the listed entities side by side."""
    wanted = F.col(names.entity).isin(list(ids))
    rows = mart.filter(wanted & in_years(names, start, end))
    return (
        with_entity(rows, entity.filter(wanted), names)
        .select(
            names.entity,
            names.name,
            names.group,
            names.year,
            names.events,
            names.severe,
            names.declarations,
            rounded(F.col(names.damage), 2).alias(names.damage),
            rounded(F.col(names.loss), 2).alias("loss_score"),
            rounded(F.col(names.risk), 4).alias("risk_score"),
            rounded(F.col(names.vulnerability), 4).alias("vulnerability"),
            rounded(F.col(names.resilience), 4).alias("resilience"),
        )
        .orderBy(names.entity, names.year)
        .limit(limit)
    )


def group_totals(
    mart: DataFrame, entity: DataFrame, start: int, end: int, limit: int = 20,
    names: Names = Names(),
) -> DataFrame:
    """Groups by total declarations.

    After the per-entity sums an entity is one row, so the distinct count of entities
    is a plain count.
    """
    per_entity = (
        mart.filter(in_years(names, start, end))
        .groupBy(names.entity)
        .agg(
            F.sum(names.declarations).alias("_declarations"),
            F.sum(names.damage).alias("_damage"),
        )
    )
    total, entities = F.col("total_declarations"), F.col("entities_affected")
    return (
        with_entity(per_entity, entity, names)
        .groupBy(names.group)
        .agg(
            F.sum("_declarations").alias("total_declarations"),
            F.count("*").alias("entities_affected"),
            F.sum("_damage").alias("_damage"),
        )
        .select(
            names.group,
            "total_declarations",
            "entities_affected",
            (total.cast("double") / F.nullif(entities, F.lit(0))).alias(
                "avg_declarations_per_entity"
            ),
            rounded(F.col("_damage"), 2).alias("total_damage"),
        )
        .orderBy(F.desc_nulls_last("total_declarations"), names.group)
        .limit(limit)
    )


def expand_categories(
    categories: Sequence[str] | str, combined: Sequence[Sequence[str]] = ()
) -> list[str]:
    """Add the other spellings of a phenomenon that is filed under several categories."""
    wanted = [categories] if isinstance(categories, str) else list(categories)
    for family in combined:
        if any(c in family for c in wanted):
            wanted += [c for c in family if c not in wanted]
    return wanted


def top_entities_by_category(
    events: DataFrame, entity: DataFrame, categories: Sequence[str] | str, start: int, end: int,
    order_col: str = "total_events", limit: int = 20, nonzero: bool = False,
    merge_combined: bool = False, names: Names = Names(),
) -> DataFrame:
    """Entities with the most events (or severe, minor cases) of a category.

    ``nonzero`` drops rows whose ranking metric is zero, after the limit as a report
    would.  With several categories each keeps its own row unless ``merge_combined``.
    """
    if order_col not in ORDER_COLUMNS:
        raise ValueError(f"Invalid order_col {order_col!r}. Allowed: {list(ORDER_COLUMNS)}")
    wanted = [categories] if isinstance(categories, str) else list(categories)
    kind = F.lit("/".join(sorted(wanted))) if merge_combined else F.col(names.category)
    rows = events.filter(
        F.col(names.category).isin(wanted) & in_years(names, start, end)
    ).withColumn(names.category, kind)
    totals = rows.groupBy(names.entity, names.category).agg(
        F.sum(names.event_count).alias("total_events"),
        F.sum(names.event_severe).alias("total_severe"),
        F.sum(names.event_minor).alias("total_minor"),
        F.countDistinct(names.year).alias("years_with_events"),
    )
    top = (
        with_entity(totals, entity, names)
        .select(
            names.entity, names.name, names.group, names.category,
            "total_events", "total_severe", "total_minor", "years_with_events",
        )
        .orderBy(F.desc_nulls_last(order_col), names.entity, names.category)
        .limit(limit)
    )
    return top.filter(F.col(order_col) > 0) if nonzero else top


def latest_snapshot(
    mart: DataFrame, year: int | None = None, names: Names = Names()
) -> DataFrame:
    """Scored rows of one year; without a year, of the newest one in the table."""
    scored = mart.filter(F.col(names.loss).isNotNull())
    if year is not None:
        return scored.filter(F.col(names.year) == year)
    # One row; as a literal it prunes before anything is aggregated.
    newest = mart.agg(F.max(names.year)).first()[0]
    return scored.filter(F.col(names.year) == F.lit(newest))


def entity_rank(
    report: DataFrame, metric: str, ids: Sequence | None = None, names: Names = Names()
) -> DataFrame:
    """Rank of entities inside a report by ``metric`` descending; ties share a rank.

    A value's rank is one plus the rows above it, so only distinct values are ordered, in
    ranges that are summed one after the other.
    """
    levels = report.groupBy(metric).agg(F.count("*").alias("_rows"))
    order = levels.select(
        "*", F.col(metric).isNull().alias("_last"), (-F.col(metric)).alias("_falling")
    )
    above = running_total(order, ["_last", "_falling"], "_rows", "_above")
    ranks = above.select(F.col(metric).alias("_metric"), (F.col("_above") + 1).alias("rank"))
    ranked = report.join(ranks, report[metric].eqNullSafe(ranks["_metric"])).drop("_metric")
    return ranked if ids is None else ranked.filter(F.col(names.entity).isin(list(ids)))


def entity_labels(df: DataFrame, names: Names = Names()) -> DataFrame:
    """``label`` = "name, group": unambiguous where a name occurs in several groups."""
    return df.withColumn("label", F.concat_ws(", ", names.name, names.group))
