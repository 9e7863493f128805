"""Dummy coding of a categorical column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def dummy_columns(column: str, levels: Sequence[str]) -> list[str]:
    return [f"{column}_{level}" for level in levels]


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Replace a category by one 0/1 column per level; null stays null, other values fail."""
    value = F.col(column)
    message = F.concat(F.lit(f"{column} has no level "), value.cast("string"))
    known = F.when(value.isNull() | value.isin(*levels), value).otherwise(
        F.raise_error(message).cast(df.schema[column].dataType)
    )
    dummies = {
        name: (known == level).cast("double")
        for name, level in zip(dummy_columns(column, levels), levels)
    }
    return df.withColumns(dummies).drop(column)
