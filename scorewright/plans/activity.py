"""Series over time and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorewright.functions.dates import SORTABLE_SEASON_NAMES
from scorewright.operators import ranking, segments, series
from scorewright.plans.inputs import Inputs

#: Points of the few events that the series on the calendar is made of.
_BUSY = 2_150


def q43_monthly_activity(t: Inputs) -> DataFrame:
    return series.monthly_activity(t.facts).orderBy("month")


def q44_monthly_extent(t: Inputs) -> DataFrame:
    return series.series_extent(
        series.monthly_activity(t.facts), ["total_points", "total_users"]
    )


def q44_monthly_changes(t: Inputs) -> DataFrame:
    monthly = series.monthly_activity(t.facts)
    changed = series.with_change(monthly, "total_points", "month")
    changed = series.with_change(changed, "total_users", "month")
    return series.with_change_label(changed, "total_points").orderBy("month")


def q44_monthly_changes_on_calendar(t: Inputs) -> DataFrame:
    """Of the busiest days alone, so that some months have no events."""
    busy = t.facts.where(F.col("points") >= _BUSY)
    monthly = series.monthly_activity(busy)
    return series.on_calendar(monthly, ["total_points", "total_users"]).orderBy("month")


def q45_monthly_points_of_positive_users(t: Inputs) -> DataFrame:
    return segments.monthly_points_of_class(t.facts, segments.POSITIVE, "total_positive_points")


def q46_monthly_points_of_negative_users(t: Inputs) -> DataFrame:
    return segments.monthly_points_of_class(t.facts, segments.NEGATIVE, "total_negative_points")


def _signed_monthly_points(t: Inputs) -> DataFrame:
    return segments.monthly_points_by_class(t.facts).where(
        F.col("user_type").isin(segments.POSITIVE, segments.NEGATIVE)
    )


def q47_class_extent(t: Inputs) -> DataFrame:
    return series.series_extent(_signed_monthly_points(t), ["points"], ["user_type"])


def q47_class_changes(t: Inputs) -> DataFrame:
    changed = series.with_change(_signed_monthly_points(t), "points", "month", ["user_type"])
    return series.with_change_label(changed, "points").orderBy("user_type", "month")


def q48_facts_with_season(t: Inputs) -> DataFrame:
    return series.tag_season(t.facts)


def q49_season_hour_totals(t: Inputs) -> DataFrame:
    return series.season_hour_totals(t.facts, SORTABLE_SEASON_NAMES).orderBy("season", "hour")


def q50_daily_totals(t: Inputs) -> DataFrame:
    return series.daily_totals(t.facts).orderBy("day")


def q50_daily_extent(t: Inputs) -> DataFrame:
    return series.series_extent(series.daily_totals(t.facts), ["total_points"])


def q51_extreme_days(t: Inputs) -> DataFrame:
    return series.extreme_days(t.facts)


def q52_top_players_per_month(t: Inputs) -> DataFrame:
    return ranking.top_players_per_month(t.facts, 2)
