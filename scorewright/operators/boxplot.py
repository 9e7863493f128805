"""Box-plot data of user totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from scorewright.operators.ranking import quantiles_by_narrowing
from scorewright.sources.storage import materialize

# Fixed value: whiskers reach at most this many interquartile ranges beyond the box.
WHISKER_REACH = 1.5

_GROUP = ("attribute", "level")


def _by_attribute(totals: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per user and attribute: (attribute, level, userid, total_points)."""
    levels = [
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("level"))
        for a in attributes
    ]
    return totals.select(F.inline(F.array(*levels)), "userid", "total_points").where(
        F.col("level").isNotNull()
    )


def _with_fences(totals: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """The users of every level with the quartiles and fences of their level.

    The totals are written once, whatever the number of attributes, and read in each round
    that narrows the quartiles.  The quartiles are written out too: Catalyst then sees one
    small row per level and joins them to the users without a shuffle.
    """
    stored = materialize(totals.select("userid", "total_points", *attributes), "box-totals")
    rows = _by_attribute(stored, attributes)
    quartiles = materialize(
        quantiles_by_narrowing(rows, "total_points", _GROUP, {"q1": 0.25, "median": 0.5, "q3": 0.75}),
        "quartiles",
    )
    fences = quartiles.selectExpr(
        "*",
        f"q1 - {WHISKER_REACH}D * (q3 - q1) as low_fence",
        f"q3 + {WHISKER_REACH}D * (q3 - q1) as high_fence",
    )
    return rows.join(fences, list(_GROUP))


def box_stats(totals: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends and number of outliers per level of each attribute.

    Whiskers end at the outermost totals inside the fences, but never inside the box.
    """
    rows = _with_fences(totals, attributes)
    total = F.col("total_points")
    inside = total.between(F.col("low_fence"), F.col("high_fence"))
    stats = rows.groupBy(*_GROUP, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, total)).alias("lowest_inside"),
        F.max(F.when(inside, total)).alias("highest_inside"),
        F.count_if(~inside).alias("num_outliers"),
    )
    return stats.select(
        *_GROUP,
        "n",
        "q1",
        "median",
        "q3",
        F.least("lowest_inside", "q1").alias("whisker_low"),
        F.greatest("highest_inside", "q3").alias("whisker_high"),
        "num_outliers",
    ).orderBy(*_GROUP)


def outliers(totals: DataFrame, attribute: str, level: str) -> DataFrame:
    """Users of one level whose total lies beyond the fences."""
    of_level = totals.where(F.col(attribute) == level)
    rows = _with_fences(of_level, [attribute])
    return rows.where(~F.col("total_points").between(F.col("low_fence"), F.col("high_fence"))).select(
        "userid", "total_points"
    )


def top_outliers(totals: DataFrame, attribute: str, level: str, k: int = 9) -> DataFrame:
    """The ``k`` highest outliers of a level and the total that marks the last of them."""
    top = (
        outliers(totals, attribute, level)
        .orderBy(F.desc("total_points"), "userid")
        .limit(k)
    )
    everything = Window.orderBy(F.desc("total_points"), "userid").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return top.withColumn("threshold", F.min("total_points").over(everything)).orderBy(
        F.desc("total_points"), "userid"
    )
