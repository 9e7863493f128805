"""Run every job next to its SQL text and report differences.

    python -m checks.compare [data folder] [job name ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import oracle_sql
from scorewright.plans.registry import jobs


def local_session(name: str, cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{file}/*.parquet" if file.is_dir() else file
        connection.execute(f"create view {file.stem} as select * from '{files}'")
    return connection


def _cell(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    return f"{type(value).__name__} {value}"


def _rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


# Spark types and their names in the SQL engine.
_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN",
}


def difference(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both results hold the same rows, names and types, else what differs."""
    relation = connection.sql(sql)
    expected_types = sorted(zip(relation.columns, map(str, relation.types)))
    actual_types = sorted((name, _TYPES.get(kind, kind)) for name, kind in result.dtypes)
    if actual_types != expected_types:
        return f"columns {actual_types} against {expected_types}"
    actual = _rows(result.columns, result.collect())
    expected = _rows(relation.columns, relation.fetchall())
    if len(actual) != len(expected):
        return f"{len(actual)} rows against {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e:
            return f"row {a} against {e}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    spark = local_session("compare")
    connection = oracle_connection(sf_dir)
    texts = oracle_sql()
    failures = 0
    for name, job in jobs().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            found = difference(job(spark, sf_dir), connection, texts[name])
        except Exception as error:  # report and go on with the next job
            found = f"{type(error).__name__}: {str(error)[:400]}"
        failures += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {time.time() - start:6.2f}s {name} {found or ''}")
    print(f"{failures} of {len(only) or len(texts)} jobs differ")
    return failures


if __name__ == "__main__":
    arguments = sys.argv[1:]
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, arguments[1:]) else 0)
