"""Exact ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _exact(count: Column) -> Column:
    return count.cast("decimal(20,0)")


def ratio(part: Column, whole: Column, places: int) -> Column:
    """``part / whole`` of two whole numbers, rounded half up, as double.

    The quotient is a decimal with 18 fraction digits, so the rounding sees the
    true value and not a binary approximation of it.
    """
    return F.round(_exact(part) / _exact(whole), places).cast("double")


def percent(part: Column, whole: Column, places: int) -> Column:
    """``100 * part / whole``, rounded half up to ``places``."""
    return F.round(F.round(_exact(part) / _exact(whole), places + 2) * 100, places).cast("double")


def scaled(value: Column, unit: int = 100_000, places: int = 2) -> Column:
    """A value in multiples of ``unit`` (chart label scale)."""
    return ratio(value, F.lit(unit), places)
