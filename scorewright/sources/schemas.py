"""Declared schemas of the two tables, raw and clean."""

from __future__ import annotations

from datetime import date

from pyspark.sql import types as T

# Limits of valid data.
MAX_ID_LENGTH = 36
FIRST_VALID_DATE = date(2013, 1, 1)
ANALYSIS_DATE = date(2023, 7, 13)
COUNTRY_LEVELS = ("CA", "MX", "US")
CATEGORY_LEVELS = ("A", "B", "C")


def staging_users(attribute: str = "country") -> T.StructType:
    return T.StructType(
        [T.StructField(name, T.StringType()) for name in ("userid", "subscriber", attribute)]
    )


def staging_facts() -> T.StructType:
    return T.StructType(
        [T.StructField(name, T.StringType()) for name in ("userid", "event_date", "hour", "points")]
    )


def clean_users(attribute: str = "country") -> T.StructType:
    return T.StructType(
        [
            T.StructField("userid", T.StringType()),
            T.StructField("subscriber", T.IntegerType()),
            T.StructField(attribute, T.StringType()),
        ]
    )


def clean_facts() -> T.StructType:
    return T.StructType(
        [
            T.StructField("userid", T.StringType()),
            T.StructField("event_date", T.DateType()),
            T.StructField("hour", T.IntegerType()),
            T.StructField("points", T.IntegerType()),
        ]
    )
