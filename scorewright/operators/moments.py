"""Moments of user totals, kept per day and merged by addition.

The statistics of user totals need, for each profile (a combination of user attributes), the
number of users, the sum of their totals and the sum of the squares.  A user who earns ``g`` on
top of a total ``b`` adds ``2 * b * g + g * g`` to the squares.  So every batch of facts gives
rows per day and profile that add up to the moments of all totals; it reads its own facts and
one total per user, not the earlier facts.  All sums are exact decimals.

Defined results: facts of unregistered ids count from the batch on that registers the id; a null
``event_date`` is a day of its own; null points count as 0, facts without a user id as nothing.
A batch must not hold a day's facts twice; late facts of an earlier day may come in any batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.operators import encoding, hypothesis, regression
from scorewright.sources.storage import materialize

_EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class UserMoments:
    """``users``: userid and profile; ``totals``: one row per id, registered or not;
    ``days``: (day, profile, n, points, squares), where a null day also holds the users."""

    profile: tuple[str, ...]
    users: DataFrame
    totals: DataFrame
    days: DataFrame

    def add(self, facts: DataFrame, users: DataFrame | None = None) -> UserMoments:
        """The moments with further facts, and with users who are not known yet."""
        gains = materialize(_gains(facts), "day-gains")
        days, registered = self.days, self.users
        if users is not None:
            new = materialize(users.select("userid", *self.profile), "new-users")
            days = days.unionByName(_registered(new, self.totals, self.profile))
            registered = registered.unionByName(new)
        earned = _earned(gains, self.totals, registered, self.profile)
        totals = self.totals.unionByName(gains.select("userid", F.col("gain").alias("total_points")))
        return UserMoments(
            self.profile,
            registered,
            materialize(totals.groupBy("userid").agg(_sum("total_points")), "totals-so-far"),
            materialize(days.unionByName(earned), "moments"),
        )

    def by(self, columns: Sequence[str]) -> DataFrame:
        """(columns, n, points, squares) of all days."""
        return self.days.groupBy(*columns).agg(_sum("n"), _sum("points"), _sum("squares"))


def start(users: DataFrame, facts: DataFrame, profile: Sequence[str]) -> UserMoments:
    """The moments of a first batch; a profile should have few values."""
    spark = users.sparkSession
    columns = users.select("userid", *profile)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[1:])
    day = facts.schema["event_date"].dataType.simpleString()
    nothing = UserMoments(
        tuple(profile),
        columns.limit(0),
        spark.createDataFrame([], f"userid string, total_points {_EXACT}"),
        spark.createDataFrame([], f"day {day}, {kinds}, n {_EXACT}, points {_EXACT}, squares {_EXACT}"),
    )
    return nothing.add(facts, users)


def _sum(column: str | Column, name: str | None = None) -> Column:
    return F.coalesce(F.sum(column).cast(_EXACT), F.lit(0).cast(_EXACT)).alias(name or str(column))


def _gains(facts: DataFrame) -> DataFrame:
    """(day, userid, gain): one row per user and day, combined before the shuffle."""
    return (
        facts.where("userid IS NOT NULL")
        .groupBy(F.col("event_date").alias("day"), "userid")
        .agg(_sum("points", "gain"))
    )


def _registered(new: DataFrame, totals: DataFrame, profile: Sequence[str]) -> DataFrame:
    """New users with what they earned before they were registered, on no day."""
    rows = new.join(totals, "userid", "left")
    total = F.coalesce("total_points", F.lit(0).cast(_EXACT))
    return rows.groupBy(*profile).agg(
        F.lit(None).cast("date").alias("day"),
        F.count("*").cast(_EXACT).alias("n"),
        _sum(total, "points"),
        _sum((total * total).cast(_EXACT), "squares"),
    )


def _earned(
    gains: DataFrame, totals: DataFrame, users: DataFrame, profile: Sequence[str]
) -> DataFrame:
    """What each day adds; a user's window has a row per day of the batch at most."""
    earlier = Window.partitionBy("userid").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(_EXACT)
    before = F.coalesce("total_points", zero) + F.coalesce(F.sum("gain").over(earlier), zero)
    placed = gains.join(totals, "userid", "left").select(
        "day", "userid", "gain", before.cast("decimal(19,0)").alias("before")
    )
    gain = F.col("gain").cast("decimal(18,0)")
    squares = (2 * F.col("before") + gain) * gain
    return (
        placed.join(users, "userid")
        .groupBy("day", *profile)
        .agg(
            F.lit(0).cast(_EXACT).alias("n"),
            _sum("gain", "points"),
            _sum(squares.cast(_EXACT), "squares"),
        )
    )


# From here on the rows of the profiles, which are few, are on the driver, as exact numbers.


def _block(rows: list, xs: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of users, and means and centred co-moments of ``xs`` and the totals."""
    complete = [r for r in rows if all(r[x] is not None for x in xs)]
    n = sum(int(r["n"]) for r in complete)
    values = [[Fraction(r[x]) for x in xs] for r in complete]
    sums = [
        *[sum(v[i] * int(r["n"]) for v, r in zip(values, complete)) for i in range(len(xs))],
        sum((Fraction(int(r["points"])) for r in complete), Fraction(0)),
    ]
    p = len(xs)
    block = np.zeros((p + 1, p + 1))
    for i, j in combinations_with_replacement(range(p + 1), 2):
        if i == p:
            products = sum(int(r["squares"]) for r in complete)
        elif j == p:
            products = sum(v[i] * int(r["points"]) for v, r in zip(values, complete))
        else:
            products = sum(v[i] * v[j] * int(r["n"]) for v, r in zip(values, complete))
        block[i, j] = block[j, i] = float(products - sums[i] * sums[j] / n) if n else 0.0
    return n, np.array([float(s / n) if n else 0.0 for s in sums]), block


def _pearson(rows: list, x: str) -> float | None:
    n, _, block = _block(rows, [x])
    if n < 2 or not block[0, 0] or not block[1, 1]:
        return None
    return float(block[0, 1] / np.sqrt(block[0, 0] * block[1, 1]))


def correlation(moments: UserMoments, x: str, places: int = 4) -> DataFrame:
    """Pearson correlation of a numeric profile column and the totals."""
    spark = moments.days.sparkSession
    found = _pearson(moments.by([x]).collect(), x)
    return spark.createDataFrame([(found,)], "correlation double").select(
        F.round("correlation", places).alias("correlation")
    )


def fit_linear(moments: UserMoments, attribute: str, levels: Sequence[str]) -> regression.LinearFit:
    """Least squares of the totals on the other profile columns and the attribute's dummies."""
    others = [c for c in moments.profile if c != attribute]
    xs = [*others, *encoding.dummy_columns(attribute, levels)[1:]]
    rows = encoding.one_hot(moments.by(moments.profile), attribute, levels).collect()
    return regression.solve(xs, *_block(rows, xs))


def one_way_anova(moments: UserMoments, attribute: str) -> DataFrame:
    """Equality of the mean totals of an attribute's levels."""
    groups = []
    for row in moments.by([attribute]).where(F.col(attribute).isNotNull() & (F.col("n") > 0)).collect():
        n, mean, block = _block([row], [])
        groups.append((row[attribute], n, float(mean[0]), float(block[0, 0] / n)))
    spark = moments.days.sparkSession
    kind = moments.days.schema[attribute].dataType.simpleString()
    frame = spark.createDataFrame(groups, f"level {kind}, n bigint, mean double, variance double")
    return hypothesis.anova_of_groups(frame)


def correlation_by_month(moments: UserMoments, x: str, places: int = 4) -> DataFrame:
    """(month, correlation): Pearson correlation of the totals at the end of each month.

    For facts that came in the order of their days; users count from the start.  Months with
    facts of registered users are reported, a row per month and value of ``x`` is windowed.
    """
    month = F.trunc("day", "month").alias("month")
    monthly = moments.days.groupBy(month, x).agg(_sum("n"), _sum("points"), _sum("squares"))
    # Every value of x needs a row in each month, so that the running sums meet.
    values = F.collect_set(F.struct(F.col(x).alias("x"))).alias("values")
    listed = monthly.where(F.col(x).isNotNull()).agg(values)
    months = monthly.where("month IS NOT NULL").select("month").distinct()
    grid = months.select("month", F.explode(listed.scalar()).alias("v")).select("month", F.col("v.x").alias(x))
    running = Window.partitionBy(x).orderBy(F.col("month").asc_nulls_first())
    zero = F.lit(0).cast(_EXACT)
    sums = (
        grid.unionByName(monthly.where(f"month IS NULL AND `{x}` IS NOT NULL").select("month", x).distinct())
        .join(monthly.withColumnRenamed(x, "_x").withColumnRenamed("month", "_m"),
              F.col("month").eqNullSafe(F.col("_m")) & (F.col(x) == F.col("_x")), "left")
        .select("month", x, *[F.sum(F.coalesce(c, zero)).over(running).cast("double").alias(c) for c in ("n", "points", "squares")])
        .where("month IS NOT NULL")
    )
    v = F.col(x).cast("double")
    totals = sums.groupBy("month").agg(
        F.sum("n").alias("n"),
        F.sum(v * F.col("n")).alias("x"),
        F.sum(v * v * F.col("n")).alias("xx"),
        F.sum(v * F.col("points")).alias("xy"),
        F.sum("points").alias("y"),
        F.sum("squares").alias("yy"),
    )
    spread = F.expr("(n * xx - x * x) * (n * yy - y * y)")
    return totals.select(
        "month",
        F.round(F.when(spread > 0, F.expr("n * xy - x * y") / F.sqrt(spread)), places).alias("correlation"),
    )
