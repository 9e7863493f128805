"""Leaderboards, first and last rows, and ranks over whole tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.sources.storage import materialize


def top_players_per_month(facts: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` best point totals of each month of the year, with all tied players.

    The rank filter is pushed below the shuffle, so a task sends on only the rows
    of its own best ``k`` totals per month.
    """
    per_month = facts.groupBy("userid", F.month("event_date").alias("month")).agg(
        F.sum("points").alias("points_earned")
    )
    by_points = Window.partitionBy("month").orderBy(F.desc_nulls_last("points_earned"))
    return (
        per_month.withColumn("ranking", F.dense_rank().over(by_points))
        .where(F.col("ranking") <= k)
        .orderBy("month", "ranking", "userid")
    )


def first_values(df: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """The ``k`` smallest values of a column, repeats included."""
    return df.select(F.col(column).alias(name)).orderBy(F.asc_nulls_last(name)).limit(k)


def last_values(df: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """The ``k`` largest values of a column, repeats included."""
    return df.select(F.col(column).alias(name)).orderBy(F.desc_nulls_last(name)).limit(k)


def first_next_to_last(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The ``k`` smallest values beside the ``k`` largest ones, paired by position.

    The rows are counted by value first, so both ends read one small shuffle; at most ``k``
    repeats of a value matter.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    repeats = F.sequence(F.lit(1), F.least("_n", F.lit(k)).cast("int"))
    ends = counted.select(column, F.explode(repeats))
    first = first_values(ends, column, k, "earliest_dates")
    last = last_values(ends, column, k, "latest_dates")
    up = F.row_number().over(Window.orderBy("earliest_dates"))
    down = F.row_number().over(Window.orderBy(F.desc("latest_dates")))
    return (
        first.withColumn("rn", up)
        .join(last.withColumn("rn", down), "rn")
        .select("earliest_dates", "latest_dates")
        .orderBy("earliest_dates", "latest_dates")
    )


@dataclass(frozen=True)
class Placed:
    """Rows written in range order, and the size of every range (per group in it).

    ``rows`` has ``_place``, which counts up with the order in each range.  ``sizes`` has
    ``_first``, the group's first place in the range, ``_before``, the group's rows in
    earlier ranges, ``_size`` and the group's number of rows ``n``.
    """

    rows: DataFrame
    sizes: DataFrame
    order: tuple[str, ...]
    within: tuple[str, ...]

    @property
    def keys(self) -> list[str]:
        return [*self.within, "_range"]


def place_by_range(df: DataFrame, order: Sequence[str], within: Sequence[str] = ()) -> Placed:
    """Range-partition and sort rows by ``within`` and a unique order, and write them out.

    Large groups and runs of ties are split alike, because the order is unique.  The
    write fixes each row's range and place in it, whatever happens to tasks later, so the
    rows are shuffled and sorted once.  The sizes, one row per range and group in it, are
    written too, so that Catalyst knows their size when it chooses a join.
    """
    keys = [*within, *order]
    rows = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_place", 33)),
        "placed",
    )
    group = Window.partitionBy(*within)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(
        rows.groupBy(*within, "_range")
        .agg(F.count("*").alias("_size"), F.min("_place").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("n", F.sum("_size").over(group)),
        "range-sizes",
    )
    return Placed(rows, sizes, tuple(order), tuple(within))


def ranks(placed: Placed, ranges: Column | None = None) -> DataFrame:
    """The placed rows with their ``rank`` in the group and the group's size ``n``.

    ``ranges`` is a condition on the sizes: rows of other ranges are left out.
    """
    sizes = placed.sizes if ranges is None else placed.sizes.where(ranges)
    same_range = reduce(
        and_, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in placed.keys]
    )
    rows = placed.rows.alias("l").join(sizes.alias("r"), same_range)
    rank = F.col("r._before") + F.col("l._place") - F.col("r._first") + 1
    return rows.select("l.*", "r.n", rank.alias("rank")).drop("_place", "_range")


def global_rank(df: DataFrame, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Number the rows 1, 2, ... in a unique order, per combination of ``within``.

    No group is ever sorted in one task: the places inside each range and the sizes of the
    group's earlier ranges give the ``rank``.
    """
    return ranks(place_by_range(df, order, within))


def group_quantiles(placed: Placed, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``value``, the first order column, per group.

    Only the ranges that hold a wanted position are read again, and only the one or two
    rows around each position go on.
    """

    def ends(p: float) -> tuple[str, str, str]:
        position = f"((n - 1) * {p}D + 1)"
        return f"floor{position}", f"ceil{position}", f"({position} - floor{position})"

    wanted = [end for p in probabilities.values() for end in ends(p)[:2]]
    holds = " or ".join(f"{end} between _before + 1 and _before + _size" for end in wanted)
    near = " or ".join(f"rank = {end}" for end in wanted)

    def quantile(p: float, name: str) -> Column:
        low, high, part = ends(p)
        at_low, at_high = (f"max(case when rank = {end} then {value} end)" for end in (low, high))
        return F.expr(f"{at_low} + ({at_high} - {at_low}) * max({part})").alias(name)

    return (
        ranks(placed, F.expr(holds))
        .where(near)
        .groupBy(*placed.within)
        .agg(F.max("n").alias("n"), *[quantile(p, name) for name, p in probabilities.items()])
    )


def quantiles_by_narrowing(
    rows: DataFrame,
    value: str,
    within: Sequence[str],
    probabilities: dict[str, float],
    bins: int = 4096,
) -> DataFrame:
    """Exact interpolated quantiles of whole numbers per group, without ranking the rows.

    Every wanted position starts with the range of its group.  Each round counts the rows
    in equal parts of the ranges, combined before the shuffle, and goes on with the part
    that holds the position; after log(range, bins) rounds the part is one value.  The rows
    are read once per round; only counts and one row per wanted position are written.
    """
    keys = list(within)
    span = materialize(
        rows.groupBy(*keys).agg(
            F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        ),
        "value-ranges",
    )
    widest = span.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 1

    def position(p: float) -> str:
        return f"((n - 1) * {p}D + 1)"

    ends = [f"{f}{position(p)}" for p in probabilities.values() for f in ("floor", "ceil")]
    state = span.where("n > 0").selectExpr(
        *keys, "low", "high", "0L as before", f"explode(array_distinct(array({', '.join(ends)}))) as want"
    )
    for _ in range(max(1, math.ceil(math.log(widest, bins) - 1e-9))):
        state = materialize(state, "wanted-ranges")
        part = F.expr(f"greatest(1L, ceil((high - low + 1) / {bins}))").cast("long")
        ranges = state.select(*keys, "low", "high").distinct().withColumn("part", part)
        inside = F.col(value).between(F.col("low"), F.col("high"))
        counts = (
            rows.join(ranges, keys)
            .where(inside)
            .groupBy(*keys, "low", "high", "part", F.expr(f"({value} - low) div part").alias("bin"))
            .agg(F.count("*").alias("rows"))
        )
        so_far = Window.partitionBy(*keys, "low", "high").orderBy("bin")
        counts = counts.withColumn("until", F.sum("rows").over(so_far))
        open_ = F.col("want") - F.col("before")
        holds = (open_ <= F.col("until")) & (open_ > F.col("until") - F.col("rows"))
        state = state.join(counts, [*keys, "low", "high"]).where(holds).select(
            *keys,
            (F.col("low") + F.col("bin") * F.col("part")).alias("low"),
            F.least(F.col("high"), F.expr("low + (bin + 1) * part - 1")).alias("high"),
            (F.col("before") + F.col("until") - F.col("rows")).alias("before"),
            "want",
        )
    found = materialize(state.select(*keys, "want", F.col("low").alias("at")), "wanted-values")

    def quantile(p: float, name: str) -> Column:
        low, high = (f"max(case when want = {f}{position(p)} then at end)" for f in ("floor", "ceil"))
        part = f"max({position(p)} - floor{position(p)})"
        return F.expr(f"{low} + ({high} - {low}) * {part}").alias(name)

    return span.join(found, keys).groupBy(*keys).agg(
        F.max("n").alias("n"), *[quantile(p, name) for name, p in probabilities.items()]
    )
