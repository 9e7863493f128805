"""Exact distinct counts that merge: users as bits of bitmaps, one bitmap per period.

Users get dense numbers once.  A period's users are bitmaps of 32,768 numbers each; coarser
periods are the union of finer ones, so months give quarters and years without the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.operators.ranking import global_rank
from scorewright.sources.storage import materialize


def dense_numbers(df: DataFrame, key: str = "userid", known: DataFrame | None = None) -> DataFrame:
    """(key, number): 1, 2, ... for the distinct non-null keys; known ones keep theirs.

    ``known`` is an earlier result: new keys are numbered behind it.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    if known is None:
        return global_rank(keys, [key]).select(key, F.col("rank").alias("number"))
    last = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    new = global_rank(keys.join(known, key, "left_anti"), [key])
    return known.unionByName(new.select(key, (F.col("rank") + last).alias("number")))


def bitmaps(df: DataFrame, numbers: DataFrame, period: Column, key: str = "userid") -> DataFrame:
    """(period, bucket, bitmap): the keys of each period; a key's rows are combined first."""
    once = df.select(period.alias("period"), key).distinct()
    return (
        once.join(numbers, key)
        .groupBy("period", F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))
    )


def merged(maps: DataFrame, period: Column) -> DataFrame:
    """The bitmaps of coarser periods, or of several tables put together."""
    return maps.groupBy(period.alias("period"), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def distinct_counts(maps: DataFrame, name: str) -> DataFrame:
    """(period, name): number of distinct keys of each period."""
    return maps.groupBy("period").agg(F.sum(F.bitmap_count("bitmap")).alias(name))


def counts_by_month_quarter_year(df: DataFrame, day: str, key: str, name: str) -> DataFrame:
    """(unit, period, name) for months, quarters and years, from one table of bitmaps."""
    numbers = materialize(dense_numbers(df, key), "dense-numbers")
    months = materialize(bitmaps(df, numbers, F.trunc(day, "month"), key), "month-bitmaps")
    units = [
        distinct_counts(merged(months, F.trunc("period", unit)), name).select(
            F.lit(unit).alias("unit"), "period", name
        )
        for unit in ("month", "quarter", "year")
    ]
    return units[0].unionByName(units[1]).unionByName(units[2])
