"""Joins of facts and users on the user id.

No side carries a broadcast hint: Catalyst broadcasts the users only while their
size stays under ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges beyond
it, where adaptive execution splits the partition of a hot user.  Wherever a
result does not need single fact rows, the facts are grouped by user first, so
that a user with very many rows is one row by the time of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def user_totals(facts: DataFrame) -> DataFrame:
    """One row per player: total points and number of fact rows."""
    return facts.groupBy("userid").agg(
        F.sum("points").alias("total_points"), F.count("*").alias("num_rows")
    )


def enrich_facts(facts: DataFrame, users: DataFrame, attribute: str = "country") -> DataFrame:
    """Every fact row with its user's attributes, NULL for unregistered ids."""
    return facts.join(users, "userid", "left").select(
        "userid", "subscriber", attribute, "event_date", "hour", "points"
    )


def users_with_totals(users: DataFrame, facts: DataFrame, attribute: str = "country") -> DataFrame:
    """Every registered user with the total points, 0 for those who never played."""
    totals = facts.groupBy("userid").agg(F.sum("points").alias("total_points"))
    return users.join(totals, "userid", "left").select(
        "userid",
        "subscriber",
        attribute,
        F.coalesce("total_points", F.lit(0)).cast("bigint").alias("total_points"),
    )


def matched_id_counts(facts: DataFrame, users: DataFrame) -> DataFrame:
    """Number of distinct player ids that are registered, and of all distinct player ids."""
    players = facts.select("userid").distinct()
    registered = users.select(F.col("userid").alias("registered")).distinct()
    return players.join(registered, F.col("userid") == F.col("registered"), "left").agg(
        F.count("registered").alias("num_unique_users_tbl"),
        F.count("userid").alias("num_unique_event_perf_tbl"),
    )


def ghost_ids(facts: DataFrame, users: DataFrame) -> DataFrame:
    """Player ids that are not registered."""
    return facts.select("userid").distinct().join(users, "userid", "left_anti")


def ghost_row_count(facts: DataFrame, users: DataFrame) -> DataFrame:
    """Number of fact rows of unregistered ids."""
    per_player = facts.groupBy("userid").agg(F.count("*").alias("n"))
    return per_player.join(users, "userid", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("ghost_userid_num_entries")
    )
