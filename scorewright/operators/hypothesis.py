"""Tests of independence: one-way analysis of variance and chi-square.

Each test is an aggregation over the levels that ends in one row; only that row
reaches the driver, for the tail probability.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scorewright.functions.distributions import chi2_upper, f_upper
from scorewright.functions.numbers import ratio
from scorewright.operators.joins import user_totals
from scorewright.operators.segments import NEGATIVE, POSITIVE, sign_class


def one_way_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """F statistic and p-value of equal group means, from group sizes, means and variances."""
    groups = (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.var_pop(value).alias("variance"),
        )
        .where("n > 0")
    )
    return anova_of_groups(groups)


def anova_of_groups(groups: DataFrame) -> DataFrame:
    """The test from a row for each group: ``n``, ``mean`` and (population) ``variance``."""
    grand_mean = groups.agg(F.expr("sum(n * mean) / sum(n)")).scalar()
    sums = (
        groups.withColumn("deviation", F.col("mean") - grand_mean)
        .agg(
            F.expr("count(*) - 1").alias("df_between"),
            F.expr("sum(n) - count(*)").alias("df_within"),
            F.expr("sum(n * deviation * deviation)").alias("between"),
            F.expr("sum(n * variance)").alias("within"),
        )
        .first()
    )
    df_between, df_within = sums["df_between"], sums["df_within"]
    if not df_between or not df_within:
        raise ValueError("the test needs two groups and more values than groups")
    within = sums["within"] / df_within
    f = sums["between"] / df_between / within if within else math.inf
    return groups.sparkSession.createDataFrame(
        [(f, f_upper(f, df_between, df_within), df_between, df_within)],
        "f_statistic double, p_value double, df_between int, df_within bigint",
    )


def _class_rows(users: DataFrame, facts: DataFrame) -> DataFrame:
    """Per user and sign class, the rows a left join of the user to that class's facts has.

    Grouping the facts by user first gives the joined row counts without the joined rows:
    a user's own fact rows when the user is of the class, else the one unmatched row.
    """
    totals = user_totals(facts)
    classes = F.explode(F.array(F.lit(POSITIVE), F.lit(NEGATIVE)))
    own = sign_class(F.col("total_points")) == F.col("user_type")
    return (
        users.join(totals, "userid", "left")
        .withColumn("user_type", classes)
        .withColumn("matched_rows", F.when(own, F.col("num_rows")).otherwise(F.lit(0)))
        .withColumn("joined_rows", F.greatest("matched_rows", F.lit(1)))
    )


def class_row_shares(
    users: DataFrame, facts: DataFrame, attributes: Sequence[str], places: int = 4
) -> DataFrame:
    """Users left-joined to the facts of each sign class: non-null shares per attribute value.

    ``user_share`` covers the columns that come from the users, ``fact_share`` those
    that come from the facts; both are relative to all joined rows of the class.
    """
    levels = [
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("level"))
        for a in attributes
    ]
    counted = (
        _class_rows(users, facts)
        .groupBy("user_type", *attributes)
        .agg(F.sum("joined_rows").alias("joined"), F.sum("matched_rows").alias("matched"))
        .select("user_type", F.inline(F.array(*levels)), "joined", "matched")
        .groupBy("user_type", "attribute", "level")
        .agg(F.sum("joined").alias("joined"), F.sum("matched").alias("matched"))
    )
    all_joined = F.sum("joined").over(Window.partitionBy("user_type", "attribute"))
    return (
        counted.withColumn("all_joined", all_joined)
        .where(F.col("level").isNotNull())
        .select(
            "user_type",
            "attribute",
            "level",
            ratio(F.col("joined"), F.col("all_joined"), places).alias("user_share"),
            ratio(F.col("matched"), F.col("all_joined"), places).alias("fact_share"),
        )
    )


def contingency_table(
    users: DataFrame, facts: DataFrame, attribute: str, grain: str = "row"
) -> DataFrame:
    """Counts per attribute level and sign class: (level, positive_users, negative_users).

    Grain ``row`` counts the rows of the users left-joined to the facts of each class, so
    every user is in both classes; grain ``user`` counts each player once, in its own class.
    """
    if grain not in ("row", "user"):
        raise ValueError("grain is 'row' or 'user'")
    rows = _class_rows(users, facts).where(F.col(attribute).isNotNull())
    count = F.col("joined_rows") if grain == "row" else (F.col("matched_rows") > 0).cast("bigint")

    def of_class(user_type: str, name: str):
        return F.sum(F.when(F.col("user_type") == user_type, count).otherwise(F.lit(0))).alias(name)

    return rows.groupBy(F.col(attribute).alias("level")).agg(
        of_class(POSITIVE, "positive_users"), of_class(NEGATIVE, "negative_users")
    )


def _with_expected(table: DataFrame) -> DataFrame:
    """Add the counts expected under independence to a (level, positive, negative) table.

    Products of counts are formed as doubles: they leave the range of whole numbers.
    """
    positive = table.agg(F.sum("positive_users")).scalar()
    negative = table.agg(F.sum("negative_users")).scalar()
    both = (F.col("positive_users") + F.col("negative_users")).cast("double")
    return table.withColumns(
        {
            "expected_positive": both * positive / (positive + negative),
            "expected_negative": both * negative / (positive + negative),
        }
    )


def expected_counts(table: DataFrame, places: int = 4) -> DataFrame:
    """Observed and expected counts of a (level, positive, negative) table."""
    return _with_expected(table).select(
        "level",
        "positive_users",
        "negative_users",
        F.round("expected_positive", places).alias("expected_positive"),
        F.round("expected_negative", places).alias("expected_negative"),
    )


def chi_square(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Chi-square test of independence on a (level, positive, negative) table.

    With one degree of freedom the deviations are reduced by up to one half (Yates).
    """

    def statistic(correction: float) -> Column:
        terms = []
        for side in ("positive", "negative"):
            expected = F.col(f"expected_{side}")
            deviation = F.abs(F.col(f"{side}_users") - expected)
            reduced = deviation - F.least(F.lit(correction), deviation)
            terms.append(F.try_divide(reduced * reduced, expected))
        return F.sum(terms[0] + terms[1])

    sums = (
        _with_expected(table)
        .agg(
            (F.count("*") - 1).alias("dof"),
            F.min(F.least("expected_positive", "expected_negative")).alias("least_expected"),
            statistic(0.0).alias("plain"),
            statistic(0.5).alias("corrected"),
        )
        .first()
    )
    if not sums["least_expected"]:
        raise ValueError("every level and every class needs at least one count")
    dof = sums["dof"]
    chi2 = sums["corrected"] if dof == 1 else sums["plain"]
    return spark.createDataFrame(
        [(chi2, chi2_upper(chi2, dof), dof)], "chi2 double, p_value double, dof int"
    )
