"""CSV in and out, always with a declared schema applied by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scorewright.sources.csv_records import has_line_breaks_in_quotes, records
from scorewright.sources.storage import materialize


_MALFORMED = "malformed_line"
#: Where a record stands, for callers that ask for it.
POSITION = ["file", "line"]


def _reader(spark: SparkSession, schema: T.StructType, header: bool, mode: str):
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("dateFormat", "yyyy-MM-dd")
        .option("columnPruning", False)
        .option("mode", mode)
    )


def load_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Read CSV by position: header texts are skipped, doubled quotes are unescaped.

    A line with another number of fields, or a value that does not fit its type, fails the job.
    Line breaks inside quotes belong to their value.
    """
    if has_line_breaks_in_quotes(spark, path):
        rows = _parsed_records(spark, path, schema, header)
        broken = F.concat(F.lit("malformed record at line "), F.col("line"), F.lit(" of "), F.col("file"))
        fits = F.when(F.col(_MALFORMED).isNull(), True).otherwise(F.raise_error(broken).cast("boolean"))
        return rows.where(fits).select(*schema.names)
    return _reader(spark, schema, header, "FAILFAST").csv(path)


def _parsed_records(
    spark: SparkSession, path: str, schema: T.StructType, header: bool
) -> DataFrame:
    """The columns, ``malformed_line``, and the file and line where each record begins."""
    noted = T.StructType([*schema.fields, T.StructField(_MALFORMED, T.StringType())])
    options = {
        "escape": '"',
        "dateFormat": "yyyy-MM-dd",
        "columnNameOfCorruptRecord": _MALFORMED,
        "mode": "PERMISSIVE",
        "maxCharsPerColumn": "-1",
    }
    found = records(spark, path)
    if header:
        found = found.where("line > 1")
    row = found.withColumn("row", F.from_csv("value", noted.simpleString(), options))
    malformed = F.when(~F.col("whole"), F.col("value")).otherwise(F.col(f"row.{_MALFORMED}"))
    return row.select(
        *[F.col("row")[name].alias(name) for name in schema.names], malformed.alias(_MALFORMED), *POSITION
    )


def load_csv_lines(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, positions: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The records that fit the schema, and the others as they stand (``malformed_line``).

    The parsed records are written once to the shared folder; both parts are read from
    there.  With ``positions`` both have the ``file`` and ``line`` where a record begins.
    Files without line breaks inside quotes are parsed line by line.
    """
    kept = POSITION if positions else []
    if positions or has_line_breaks_in_quotes(spark, path):
        parsed = _parsed_records(spark, path, schema, header)
    else:
        noted = T.StructType([*schema.fields, T.StructField(_MALFORMED, T.StringType())])
        reader = _reader(spark, noted, header, "PERMISSIVE")
        parsed = reader.option("columnNameOfCorruptRecord", _MALFORMED).csv(path)
    lines = materialize(parsed, "csv-lines")
    bad = F.col(_MALFORMED).isNotNull()
    return (
        lines.where(~bad).select(*schema.names, *kept),
        lines.where(bad).select(_MALFORMED, *kept),
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Write headed CSV that keeps outer blanks and doubles inner quotes."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("dateFormat", "yyyy-MM-dd")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
