"""Yearly trends and changes between two periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mean, percent_change, rounded
from ..schemas import Names
from .ranking import in_years, with_entity

Period = tuple[int, int]


def yearly_trend(
    mart: DataFrame, start: int, end: int, limit: int = 100, names: Names = Names()
) -> DataFrame:
    """Entities, events, severe cases, damage, declarations and score per year."""
    return (
        mart.filter(in_years(names, start, end))
        .groupBy(names.year)
        .agg(
            F.countDistinct(names.entity).alias("entities_affected"),
            F.sum(names.events).alias("total_events"),
            F.sum(names.severe).alias("total_severe"),
            rounded(mean(F.col(names.avg_damage)), 2).alias("avg_damage"),
            F.sum(names.declarations).alias("total_declarations"),
            rounded(mean(F.col(names.loss)), 2).alias("avg_loss_score"),
        )
        .orderBy(names.year)
        .limit(limit)
    )


def category_trend(
    events: DataFrame, categories: Sequence[str] | str, start: int, end: int, limit: int = 100,
    names: Names = Names(),
) -> DataFrame:
    """Entities and events per year for one category; keeps the earliest ``limit`` years."""
    wanted = [categories] if isinstance(categories, str) else list(categories)
    return (
        events.filter(F.col(names.category).isin(wanted) & in_years(names, start, end))
        .groupBy(names.year)
        .agg(
            F.countDistinct(names.entity).alias("entities_affected"),
            F.sum(names.event_count).alias("total_events"),
        )
        .orderBy(names.year)
        .limit(limit)
    )


def _both_periods(df: DataFrame, before: Period, after: Period, year: str):
    early, late = F.col(year).between(*before), F.col(year).between(*after)
    return df.filter(early | late), early, late


def largest_increase(
    mart: DataFrame, entity: DataFrame, period_a: Period, period_b: Period,
    limit: int | None = 20, names: Names = Names(),
) -> DataFrame:
    """Change of the mean yearly events between two periods, largest first; None for all.

    One scan with conditional aggregates stands for the self-join of two period
    aggregates; entities without rows in both periods drop out.
    """
    rows, early, late = _both_periods(mart, period_a, period_b, names.year)
    a, b = F.col("_a"), F.col("_b")
    change = rows.groupBy(names.entity).agg(
        mean(F.when(early, F.col(names.events))).alias("_a"),
        mean(F.when(late, F.col(names.events))).alias("_b"),
        F.count_if(early).alias("_rows_a"),
        F.count_if(late).alias("_rows_b"),
    ).filter("_rows_a > 0 AND _rows_b > 0")
    report = (
        with_entity(change, entity, names)
        .select(
            names.entity, names.name, names.group,
            rounded(a, 2).alias("avg_events_early"),
            rounded(b, 2).alias("avg_events_recent"),
            rounded(b - a, 2).alias("absolute_increase"),
            rounded(percent_change(a, b), 2).alias("pct_increase"),
        )
    )
    if limit is None:
        return report
    return report.orderBy(F.desc_nulls_last("absolute_increase"), names.entity).limit(limit)


def category_increase(
    events: DataFrame, entity: DataFrame, categories: Sequence[str] | str,
    period_a: Period, period_b: Period, limit: int = 20, names: Names = Names(),
) -> DataFrame:
    """Growth of the event total of a category between two periods; only real growth."""
    wanted = [categories] if isinstance(categories, str) else list(categories)
    rows, early, late = _both_periods(
        events.filter(F.col(names.category).isin(wanted)), period_a, period_b, names.year
    )
    a, b = F.col("events_early_period"), F.col("events_recent_period")
    change = (
        rows.groupBy(names.entity)
        .agg(
            F.sum(F.when(early, F.col(names.event_count))).alias("events_early_period"),
            F.sum(F.when(late, F.col(names.event_count))).alias("events_recent_period"),
            F.count_if(early).alias("_rows_a"),
            F.count_if(late).alias("_rows_b"),
        )
        .filter("_rows_a > 0 AND _rows_b > 0")
        .withColumn("absolute_increase", b - a)
        .filter("absolute_increase > 0")
    )
    return (
        with_entity(change, entity, names)
        .select(
            names.entity, names.name, names.group,
            "events_early_period", "events_recent_period", "absolute_increase",
            rounded(percent_change(a, b), 2).alias("pct_increase"),
        )
        .orderBy(F.desc_nulls_last("absolute_increase"), names.entity)
        .limit(limit)
    )


def semi_events(events: DataFrame, entities: DataFrame, names: Names = Names()) -> DataFrame:
    """Events of the entities listed in another frame."""
    return events.join(entities.select(names.entity), names.entity, "left_semi")
