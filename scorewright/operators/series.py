"""Monthly, daily, seasonal and hourly series of points and players."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from scorewright.functions.dates import SEASON_NAMES, day_label, month_start, season
from scorewright.functions.numbers import ratio, scaled


def monthly_activity(facts: DataFrame) -> DataFrame:
    """Points and distinct players per month."""
    return facts.groupBy(month_start(F.col("event_date")).alias("month")).agg(
        F.sum("points").alias("total_points"),
        F.count_distinct("userid").alias("total_users"),
    )


def on_calendar(series: DataFrame, values: Sequence[str], month: str = "month") -> DataFrame:
    """Every month from the first to the last of a series, with changes from month to month.

    A month without events has null values and ``has_events`` false; a change is null where
    one of the two months has no events, and ``after_gap`` tells that the month before has none.
    One row per month, so the one window is over few rows.
    """
    span = series.agg(F.min(month).alias("first"), F.max(month).alias("last"))
    months = span.where(F.col("first").isNotNull()).select(
        F.explode(F.expr("sequence(first, last, interval 1 month)")).alias(month)
    )
    found = months.join(series.withColumn("has_events", F.lit(True)), month, "left")
    order = Window.orderBy(month)
    changes = {f"{v}_change": F.col(v) - F.lag(v).over(order) for v in values}
    return found.withColumns(
        {
            **changes,
            "after_gap": ~F.coalesce(F.lag("has_events").over(order), F.row_number().over(order) == 1),
            "has_events": F.coalesce("has_events", F.lit(False)),
        }
    )


def daily_totals(facts: DataFrame) -> DataFrame:
    """Points per event day."""
    return facts.groupBy(F.col("event_date").alias("day")).agg(
        F.sum("points").alias("total_points")
    )


def series_extent(
    series: DataFrame, values: Sequence[str], keys: Sequence[str] = (), places: int = 4
) -> DataFrame:
    """Mean, minimum and maximum of the values of a series, overall or per key."""
    return series.groupBy(*keys).agg(
        *[
            statistic
            for value in values
            for statistic in (
                ratio(F.sum(value), F.count(value), places).alias(f"avg_{value}"),
                F.min(value).alias(f"min_{value}"),
                F.max(value).alias(f"max_{value}"),
            )
        ]
    )


def with_change(
    series: DataFrame, value: str, order: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Add the change of a series against its previous row.

    The series is already aggregated: one row per calendar period (and key).
    """
    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return series.withColumn(f"{value}_change", F.col(value) - previous)


def with_change_label(series: DataFrame, value: str) -> DataFrame:
    """Add the change in hundred-thousands, as chart labels show it."""
    return series.withColumn(f"{value}_change_scaled", scaled(F.col(f"{value}_change")))


def tag_season(facts: DataFrame, names: tuple[str, str, str, str] = SEASON_NAMES) -> DataFrame:
    return facts.withColumn("season", season(F.col("event_date"), names))


def season_hour_totals(
    facts: DataFrame, names: tuple[str, str, str, str] = SEASON_NAMES
) -> DataFrame:
    """Points per season and hour of the day."""
    return (
        tag_season(facts, names).groupBy("season", "hour").agg(F.sum("points").alias("tot_points"))
    )


def extreme_days(facts: DataFrame) -> DataFrame:
    """The event days with the lowest and the highest total, ties included."""
    days = daily_totals(facts)
    total = F.col("total_points")
    lowest = days.agg(F.min("total_points")).scalar()
    highest = days.agg(F.max("total_points")).scalar()
    return (
        days.where((total == lowest) | (total == highest))
        .withColumn("day_label", day_label(F.col("day")))
        .orderBy("day")
    )
