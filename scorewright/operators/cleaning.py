"""Repair of raw rows: pure steps from text to typed, validated tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.dates import parse_month_day_year
from scorewright.functions.text import ID_DIRT, SCORE_DIRT, strip_chars
from scorewright.operators import quality
from scorewright.sources.schemas import ANALYSIS_DATE, FIRST_VALID_DATE, MAX_ID_LENGTH


def split_invalid_dates(staging: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose date text parses (or is missing), and the rows to drop."""
    bad = F.col("event_date").isNotNull() & parse_month_day_year("event_date").isNull()
    return staging.where(~bad), staging.where(bad)


def _with_parsed_date(staging: DataFrame, **repairs: Column) -> DataFrame:
    """Rows with a parseable (or missing) date, the date as DATE, and other columns repaired."""
    parsed = staging.withColumns(
        {
            **repairs,
            "event_date": parse_month_day_year("event_date"),
            "_no_date": F.col("event_date").isNull(),
        }
    )
    kept = F.col("event_date").isNotNull() | F.col("_no_date")
    return quality.compute_once(parsed).where(kept).select(*staging.columns)


def normalise_dates(staging: DataFrame) -> DataFrame:
    """The rows with a parseable (or missing) date, with the date column as DATE."""
    return _with_parsed_date(staging)


def typed_users(staging: DataFrame, attribute: str = "country") -> DataFrame:
    return staging.select("userid", F.col("subscriber").try_cast("int").alias("subscriber"), attribute)


def typed_facts(staging: DataFrame) -> DataFrame:
    """All rows, repaired and typed; ``no_date`` marks texts that are no calendar date."""
    day = parse_month_day_year("event_date")
    return quality.compute_once(
        staging.select(
            strip_chars(F.col("userid"), ID_DIRT).alias("userid"),
            day.alias("event_date"),
            F.col("hour").try_cast("int").alias("hour"),
            strip_chars(F.col("points"), SCORE_DIRT).try_cast("int").alias("points"),
            F.col("event_date").isNotNull().alias("no_date"),
        )
    ).withColumn("no_date", F.col("no_date") & F.col("event_date").isNull())


def user_rules(levels: Sequence[str], attribute: str = "country") -> list[quality.Rule]:
    return [
        *quality.not_null("userid", "subscriber", attribute),
        quality.max_length("userid", MAX_ID_LENGTH),
        quality.in_set("subscriber", (0, 1)),
        quality.in_set(attribute, levels),
    ]


def fact_rules(as_of: date = ANALYSIS_DATE) -> list[quality.Rule]:
    return [
        *quality.not_null("userid"),
        quality.Rule("event_date_not_null", F.col("event_date").isNull() & ~F.col("no_date")),
        *quality.not_null("hour", "points"),
        quality.max_length("userid", MAX_ID_LENGTH),
        quality.Rule("parseable_event_date", F.col("no_date")),
        quality.in_range("hour", 0, 23),
        quality.in_range("event_date", F.lit(FIRST_VALID_DATE), F.lit(as_of)),
    ]


def flagged_users(
    staging: DataFrame, levels: Sequence[str], attribute: str = "country"
) -> DataFrame:
    """Every user row, typed, with the rules it breaks."""
    return quality.flag(
        typed_users(staging, attribute), user_rules(levels, attribute), unique="userid"
    )


def flagged_facts(staging: DataFrame, as_of: date = ANALYSIS_DATE) -> DataFrame:
    """Every fact row, repaired and typed, with the rules it breaks."""
    return quality.flag(typed_facts(staging), fact_rules(as_of), helpers=["no_date"])


def clean_users(
    staging: DataFrame, levels: Sequence[str], attribute: str = "country"
) -> tuple[DataFrame, DataFrame]:
    """Valid users, and rejected rows with their reasons."""
    return quality.split_flagged(quality.compute_once(flagged_users(staging, levels, attribute)))


def clean_facts(staging: DataFrame, as_of: date = ANALYSIS_DATE) -> tuple[DataFrame, DataFrame]:
    """Valid facts, and rejected rows with their reasons; each row is in one of them."""
    # The repaired values are computed once already; the rules on them are cheap.
    return quality.split_flagged(flagged_facts(staging, as_of))


def row_account(staging: DataFrame, flagged: DataFrame) -> DataFrame:
    """Where the staging rows are: (outcome, num_rows) for valid and rejected ones, and the rest."""
    fine = F.size("failed_rules") == 0
    row = flagged.agg(
        F.count_if(fine).alias("valid"),
        F.count_if(~fine).alias("rejected"),
        staging.agg(F.count("*")).scalar().alias("staging"),
    )
    unaccounted = F.col("staging") - F.col("valid") - F.col("rejected")
    entries = [("valid", F.col("valid")), ("rejected", F.col("rejected")), ("unaccounted", unaccounted)]
    return row.select(
        F.inline(
            F.array(*[F.struct(F.lit(name).alias("outcome"), n.alias("num_rows")) for name, n in entries])
        )
    )
