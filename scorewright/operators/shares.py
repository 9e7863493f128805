"""Counts, proportions and rates of users and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.functions.numbers import percent, ratio
from scorewright.operators.quality import compute_once


def with_share(
    counts: DataFrame,
    count: str,
    name: str,
    within: Sequence[str] = (),
    places: int = 4,
    as_percent: bool = False,
) -> DataFrame:
    """Add each row's share of the total of ``count``, overall or within some keys.

    ``counts`` is already grouped: one row per key combination.  The grand total is
    a scalar subquery that reads the same shuffled groups again; totals within keys
    are a window over the groups.
    """
    if within:
        total = F.sum(count).over(Window.partitionBy(*within))
    else:
        total = counts.agg(F.sum(count)).scalar()
    share = percent if as_percent else ratio
    return counts.withColumn(name, share(F.col(count), total, places))


def frequencies(
    df: DataFrame, keys: Sequence[str | Column], count: str = "num_users"
) -> DataFrame:
    """Number of rows per key combination."""
    return df.groupBy(*keys).agg(F.count("userid").alias(count))


def proportions(
    users: DataFrame, keys: Sequence[str], within: Sequence[str] = (), places: int = 3
) -> DataFrame:
    """Share of users per key combination."""
    counted = frequencies(users, keys)
    return with_share(counted, "num_users", "proportion", within, places).select(
        *keys, "proportion"
    )


def percentages(
    users: DataFrame, keys: Sequence[str], within: Sequence[str] = (), places: int = 2
) -> DataFrame:
    """Percentage of users per key combination."""
    counted = frequencies(users, keys)
    return with_share(counted, "num_users", "pct", within, places, as_percent=True).select(
        *keys, "pct"
    )


def stacked_frequencies(users: DataFrame, attributes: Sequence[str], places: int = 4) -> DataFrame:
    """Frequencies of several attributes below each other, from one pass over the users."""
    profiles = frequencies(users, attributes, "n")
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(position).alias("position"),
                    F.col(name).cast("string").alias("attribute"),
                )
                for position, name in enumerate(attributes)
            ]
        )
    )
    counted = (
        profiles.select(pairs.alias("pair"), "n")
        .groupBy("pair.position", "pair.attribute")
        .agg(F.sum("n").alias("num_users"))
    )
    return with_share(counted, "num_users", "rel_freq", ["position"], places).select(
        "attribute", "num_users", "rel_freq"
    )


def points_share(facts: DataFrame, users: DataFrame, key: str, places: int = 4) -> DataFrame:
    """Share of all points, unregistered ids included, per level of a user attribute.

    The outer join keeps both the points of unregistered ids, as a group without a level,
    and the levels nobody plays for, without a share; the facts are read once.
    """
    per_player = facts.groupBy("userid").agg(F.sum("points").alias("points"))
    per_level = (
        users.select("userid", key)
        .join(per_player, "userid", "full_outer")
        .groupBy(key)
        .agg(F.sum("points").alias("points"))
    )
    # Fixed before the filter, which would otherwise reach only one of the two reads of per_level.
    shares = compute_once(with_share(per_level, "points", "prop_pts_scored", places=places))
    return shares.where(F.col(key).isNotNull()).select(key, "prop_pts_scored")


def participants_by_status(facts: DataFrame, users: DataFrame) -> DataFrame:
    """Participating users per subscription status and their percentage of all player ids."""
    players = facts.select("userid").where(F.col("userid").isNotNull()).distinct()
    counted = players.join(users, "userid", "left").agg(
        F.count_if(F.col("subscriber") == 0).alias("non_subscribers"),
        F.count_if(F.col("subscriber") == 1).alias("subscribers"),
        F.count("*").alias("all_players"),
    )
    rows = [
        F.struct(F.lit(status).alias("subscriber_status"), F.col(status).alias("count"))
        for status in ("non_subscribers", "subscribers")
    ]
    return counted.select(F.inline(F.array(*rows)), "all_players").select(
        "subscriber_status",
        "count",
        percent(F.col("count"), F.col("all_players"), 2).alias("perc"),
    )


def subscription_rate(users: DataFrame, places: int = 2) -> DataFrame:
    """Percentage of registered users who subscribe."""
    return users.agg(
        percent(F.sum("subscriber"), F.count("subscriber"), places).alias("avg_subscription_rate")
    )


def rows_per_level(facts: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Fact rows per level of a user attribute; users who never played count 0."""
    per_player = facts.groupBy("userid").agg(F.count("hour").alias("cnt"))
    return (
        users.join(per_player, "userid", "left")
        .groupBy(key)
        .agg(F.sum(F.coalesce("cnt", F.lit(0))).cast("bigint").alias("cnt"))
    )
