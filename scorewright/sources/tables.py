"""Catalog tables and views, and running SQL against them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorewright.operators.joins import enrich_facts
from scorewright.sources.storage import new_path


def replace_table(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Drop and re-create a table from a frame; ``name`` may hold a database.

    Without a ``location`` the files are this application's, in the shared folder; a table
    that is to outlive it in a lasting catalog needs a location that does so too.
    """
    place = location or new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("path", place).saveAsTable(name)
    return df.sparkSession.table(name)


def insert_select(
    source: DataFrame, table: str, columns: Sequence[Column | str], where: Column | None = None
) -> DataFrame:
    """Append the selected, filtered rows of ``source`` to an existing table, by column name."""
    spark = source.sparkSession
    rows = source if where is None else source.where(where)
    rows.select(*columns).select(*spark.table(table).columns).write.insertInto(table)
    return spark.table(table)


def run_query(
    spark: SparkSession,
    sql: str,
    index_columns: Sequence[str] = (),
    date_columns: Sequence[str] = (),
    args: Mapping[str, object] | Sequence[object] | None = None,
) -> DataFrame:
    """Run a SQL query; index columns come first, date columns are parsed to DATE.

    ``args`` are values for the query's parameters (``:name`` or ``?``); they are bound, never
    pasted into the text.  Columns that the result does not have are refused.
    """
    result = spark.sql(sql, args=args) if args else spark.sql(sql)
    if unknown := {*index_columns, *date_columns}.difference(result.columns):
        raise ValueError(f"no such columns in the result: {', '.join(sorted(unknown))}")
    if date_columns:
        result = result.withColumns({name: F.to_date(name) for name in date_columns})
    others = [name for name in result.columns if name not in index_columns]
    return result.select(*index_columns, *others)


def run_step(
    step: Callable[..., DataFrame], *inputs: DataFrame, table: str, location: str | None = None
) -> DataFrame:
    """Run one pipeline step and persist its result as a table."""
    return replace_table(step(*inputs), table, location)


def create_views(
    facts: DataFrame, users: DataFrame, attribute: str = "country", names: Sequence[str] = (
        "event_performance_joined", "subscribers", "non_subscribers",
    )
) -> DataFrame:
    """Register the enriched facts and their subscriber / non-subscriber parts as views."""
    joined = enrich_facts(facts, users, attribute)
    joined.createOrReplaceTempView(names[0])
    joined.where("subscriber = 1").createOrReplaceTempView(names[1])
    joined.where("subscriber = 0").createOrReplaceTempView(names[2])
    return joined


def preview(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows under a total order, so that the preview is repeatable."""
    return df.orderBy(*order).limit(rows)
