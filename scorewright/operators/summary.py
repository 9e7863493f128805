"""One-row statistics shown as (statistic, value) tables.

The names of the statistics are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.numbers import percent, ratio


def count_distinct(df: DataFrame, column: str, name: str) -> DataFrame:
    """Exact number of distinct values of a column."""
    return df.agg(F.count_distinct(column).cast("bigint").alias(name))


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def unpivot_row(row: DataFrame, statistics: Sequence[tuple[str, Column]]) -> DataFrame:
    """Turn one row of statistics into an ordered (statistic, value) table."""
    entries = [
        F.struct(F.lit(name).alias("statistic"), value.cast("double").alias("value"))
        for name, value in statistics
    ]
    return row.select(F.inline(F.array(*entries)))


def daily_points(facts: DataFrame) -> DataFrame:
    """Total points per event, that is per calendar day."""
    return facts.groupBy("event_date").agg(F.sum("points").alias("points_per_event"))


def _num_events(facts: DataFrame) -> DataFrame:
    """Number of events, and of all days of the years they are in."""
    first = F.trunc("event_date", "year")
    days = F.datediff(F.add_months(first, 12), first)
    return (
        facts.select("event_date")
        .distinct()
        .groupBy(F.year("event_date").alias("year"))
        .agg(F.count("event_date").alias("events"), F.max(days).alias("days"))
        .agg(
            F.coalesce(F.sum("events"), F.lit(0)).cast("bigint").alias("num_events"),
            F.sum("days").alias("num_days"),
        )
    )


def _event_share() -> Column:
    return percent(F.col("num_events"), F.col("num_days"), 2)


def event_stats(facts: DataFrame) -> DataFrame:
    """Number of events, and events as a percentage of the days of their years."""
    num_events = F.col("num_events")
    return unpivot_row(
        _num_events(facts),
        [
            ("num_gaming_events", num_events),
            ("gaming_event_yrly_pct", _event_share()),
        ],
    )


def participation_stats(facts: DataFrame, users: DataFrame) -> DataFrame:
    """Events, registered users and the percentage of them who played."""
    row = _num_events(facts).select(
        "num_events",
        "num_days",
        users.agg(F.count("userid")).scalar().alias("num_users"),
        facts.agg(F.count_distinct("userid")).scalar().alias("num_players"),
    )
    num_events, num_users = F.col("num_events"), F.col("num_users")
    return unpivot_row(
        row,
        [
            ("num_gaming_events", num_events),
            ("gaming_event_yrly_pct", _event_share()),
            ("num_unique_users", num_users),
            ("participating_users_pct", percent(F.col("num_players"), num_users, 2)),
        ],
    )


def points_summary(facts: DataFrame, users: DataFrame) -> DataFrame:
    """Participation, and mean, spread and five-number summary of the points per event.

    The quartiles are exact and interpolated; their input has one row per calendar day.
    """
    points = F.col("points_per_event")
    row = daily_points(facts).agg(
        F.count("*").alias("num_events"),
        ratio(F.sum(points), F.count(points), 0).alias("mean"),
        F.round(F.stddev_samp(points), 0).alias("spread"),
        F.min(points).alias("low"),
        F.percentile(points, [0.25, 0.5, 0.75]).alias("quartiles"),
        F.max(points).alias("high"),
    )
    row = row.select(
        "*",
        users.agg(F.count("userid")).scalar().alias("num_users"),
        facts.agg(F.count_distinct("userid")).scalar().alias("num_players"),
    )
    quartiles = F.col("quartiles")
    return unpivot_row(
        row,
        [
            ("num_gaming_events", F.col("num_events")),
            ("num_unique_users", F.col("num_users")),
            ("participating_users_pct", percent(F.col("num_players"), F.col("num_users"), 2)),
            ("avg_tot_pts_per_event", F.col("mean")),
            ("std_dev_tot_pts_per_event", F.col("spread")),
            ("min_event_pts", F.col("low")),
            ("q1_event_pts", quartiles[0]),
            ("median_event_pts", quartiles[1]),
            ("q3_event_pts", quartiles[2]),
            ("max_event_pts", F.col("high")),
            ("range", F.col("high") - F.col("low")),
        ],
    )
