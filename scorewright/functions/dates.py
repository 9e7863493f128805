"""Date parsing and date parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Shape of a date text; two-digit years from 70 on belong to the 1900s.
MONTH_DAY_YEAR = "^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})$"
CENTURY_PIVOT = "70"

# Season names and the months they cover; the last name takes the rest of the year.
SEASON_MONTHS = ((3, 4, 5), (6, 7, 8), (9, 10, 11))
SEASON_NAMES = ("spring", "summer", "fall", "winter")
SORTABLE_SEASON_NAMES = ("0_spring", "1_summer", "2_fall", "3_winter")


def parse_month_day_year(column: str) -> Column:
    """Parse the ``M/D/YY`` or ``M/D/YYYY`` texts of a column; NULL for what is no calendar date."""
    column = "`" + column.replace("`", "``") + "`"
    month, day, year = (f"split_part({column}, '/', {i})" for i in (1, 2, 3))
    century = f"case when length({year}) = 4 then '' when {year} >= '{CENTURY_PIVOT}' then '19' else '20' end"
    iso = f"concat({century}, {year}, '-', {month}, '-', {day})"
    return F.expr(f"case when {column} rlike '{MONTH_DAY_YEAR}' then try_cast({iso} as date) end")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def season(day: Column, names: tuple[str, str, str, str] = SEASON_NAMES) -> Column:
    """Season name of a date; months outside the first three seasons get the last name."""
    month = F.month(day)
    branches = F
    for months, name in zip(SEASON_MONTHS, names):
        branches = branches.when(month.isin(*months), F.lit(name))
    return branches.otherwise(F.lit(names[-1]))


def day_label(day: Column) -> Column:
    return F.date_format(day, "MM-dd")
