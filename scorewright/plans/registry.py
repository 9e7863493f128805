"""All named jobs, callable with a session and a data folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorewright.plans import activity, loading, participation, statistics, stored
from scorewright.plans.inputs import CleanedOrderTables, Inputs, OrderTables

_JOB_NAME = re.compile(r"[qs]\d\d_\w+")

Job = Callable[[SparkSession, str], DataFrame]

#: Jobs that are also run from the raw rows to the result.
AFTER_CLEANING = ("q30_points_summary", "q52_top_players_per_month", "q66_multiple_regression")


def jobs_on_inputs() -> dict[str, Callable[[Inputs], DataFrame]]:
    """The jobs over any loaded tables, such as ``CsvTables``."""
    found = {
        name: job
        for module in (loading, participation, activity, statistics, stored)
        for name, job in vars(module).items()
        if _JOB_NAME.fullmatch(name)
    }
    return dict(sorted(found.items()))


def jobs() -> dict[str, Job]:
    """The jobs over the tables derived from one data folder."""
    found = jobs_on_inputs()
    derived = {
        name: lambda spark, sf_dir, job=job: job(OrderTables(spark, sf_dir))
        for name, job in found.items()
    }
    cleaned = {
        f"{name}_after_cleaning": lambda spark, sf_dir, job=found[name]: job(
            CleanedOrderTables(spark, sf_dir)
        )
        for name in AFTER_CLEANING
    }
    return derived | cleaned
