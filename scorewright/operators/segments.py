"""Users split by the sign of their total points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.operators.joins import user_totals
from scorewright.operators.shares import with_share
from scorewright.sources.storage import materialize

# Names of the sign classes.
POSITIVE, NEGATIVE, ZERO = "total_points_positive", "total_points_negative", "total_points_zero"


def sign_class(total: Column) -> Column:
    return F.when(total > 0, POSITIVE).when(total < 0, NEGATIVE).when(total == 0, ZERO)


def classified_totals(facts: DataFrame) -> DataFrame:
    """Total points, number of fact rows and sign class per player."""
    return user_totals(facts).withColumn("user_type", sign_class(F.col("total_points")))


def sign_class_frequencies(facts: DataFrame, places: int = 4) -> DataFrame:
    """Players per sign class and their share of all players, largest class first."""
    counted = (
        classified_totals(facts)
        .where(F.col("user_type").isNotNull())
        .groupBy("user_type")
        .agg(F.count("*").alias("num_users"))
    )
    return with_share(counted, "num_users", "rel_freq", places=places).orderBy(
        F.desc("num_users"), "user_type"
    )


def facts_of_class(facts: DataFrame, user_type: str) -> DataFrame:
    """The fact rows of the players of one class (a semi-join on the class's ids)."""
    return facts.join(_ids_of_class(facts, user_type), "userid", "left_semi")


def _ids_of_class(facts: DataFrame, user_type: str) -> DataFrame:
    """The ids of a class, written: adaptive execution splits a hot player's rows only where
    the other side of the join is a plain scan."""
    ids = classified_totals(facts).where(F.col("user_type") == user_type).select("userid")
    return materialize(ids, "class-ids")


def users_with_facts_of_class(users: DataFrame, facts: DataFrame, user_type: str) -> DataFrame:
    """Every user beside each fact row, if the user is of the class, or one row without a fact.

    The users of the class are joined to the facts as the smaller side of an inner join; the
    others follow with nulls.
    """
    ids = _ids_of_class(facts, user_type)
    of_class = materialize(users.join(ids, "userid"), "class-users")
    matched = of_class.join(facts, "userid")
    rest = users.join(ids, "userid", "left_anti")
    missing = [f for f in facts.schema.fields if f.name != "userid"]
    return matched.unionByName(
        rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    )


def classified_facts(facts: DataFrame) -> DataFrame:
    """Every fact row of a player above or below zero, with the player's class.

    One join serves both classes.  The classes are written first, so that adaptive
    execution can split a hot player's rows.
    """
    classes = materialize(
        classified_totals(facts)
        .where(F.col("user_type").isin(POSITIVE, NEGATIVE))
        .select("userid", "user_type"),
        "class-ids",
    )
    return facts.join(classes, "userid")


def monthly_points_by_class(facts: DataFrame) -> DataFrame:
    """Points per month and sign class.

    The facts are read once: points per player and month give both the player's total
    (a window over at most one row per month) and the monthly sums.
    """
    per_month = facts.groupBy("userid", F.trunc("event_date", "month").alias("month")).agg(
        F.sum("points").alias("points")
    )
    total = F.sum("points").over(Window.partitionBy("userid"))
    return (
        per_month.withColumn("user_type", sign_class(total))
        .groupBy("user_type", "month")
        .agg(F.sum("points").alias("points"))
    )


def monthly_points_of_class(facts: DataFrame, user_type: str, name: str) -> DataFrame:
    return (
        monthly_points_by_class(facts)
        .where(F.col("user_type") == user_type)
        .select("month", F.col("points").alias(name))
        .orderBy("month")
    )
