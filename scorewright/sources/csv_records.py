"""CSV records over lines: which line breaks stand inside quotes, and where a record begins.

Files are read in splits, and a split cannot know whether it begins inside quotes.  The
number of quote characters of each block of a file is added up over the blocks before it;
with the quotes before a line in its own block that tells, for all blocks at once, whether
the line begins inside quotes.  As in COPY, every quote character opens or closes; a doubled
one does both.  The same sums number the lines, so each record has a file and a line.

A quote that is never closed would make one record of the rest of its file: records of more
than ``MOST_LINES`` lines are given back line by line as malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scorewright.sources.storage import materialize

MOST_LINES = 10_000

_BLOCK = ["file", "block"]


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def has_line_breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line holds an odd number of quotes, so that records differ from lines."""
    odd = _text(spark, path).where(_quotes(F.col("value")) % 2 == 1)
    return not odd.isEmpty()


def _with_sum_before(blocks: DataFrame, column: str, name: str) -> DataFrame:
    """A column's sum over the earlier blocks of the file; one row per block."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(name, F.coalesce(F.sum(column).over(earlier), F.lit(0)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value, quotes, and ``inside``: the line begins inside quotes."""
    lines = materialize(
        _text(spark, path).select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            _quotes(F.col("value")).alias("quotes"),
        ),
        "lines",
    )
    blocks = lines.groupBy(*_BLOCK).agg(
        F.sum("quotes").alias("block_quotes"), F.count("*").alias("n"), F.min("place").alias("first")
    )
    blocks = _with_sum_before(blocks, "block_quotes", "quotes_before")
    blocks = materialize(_with_sum_before(blocks, "n", "lines_before"), "blocks")
    before = Window.partitionBy(*_BLOCK).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.col("quotes_before") + F.coalesce(F.sum("quotes").over(before), F.lit(0))) % 2 == 1
    return lines.join(blocks, _BLOCK).select(
        *_BLOCK,
        (F.col("lines_before") + F.col("place") - F.col("first") + 1).alias("line"),
        "value",
        "quotes",
        inside.alias("inside"),
    )


def records(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> DataFrame:
    """file, line, value, whole: every record that is not blank, with the line it begins at.

    Line breaks inside quotes stay as they are.  ``whole`` is false for what an unclosed
    quote leaves, and for the lines of a record that is too long.
    """
    lines = materialize(numbered_lines(spark, path), "numbered-lines")
    alone = ~F.col("inside") & (F.col("quotes") % 2 == 0)
    single = lines.where(alone).select("file", "line", "value", F.lit(True).alias("whole"))

    parts = lines.where(~alone).withColumn("begins", (~F.col("inside")).cast("long"))
    blocks = parts.groupBy(*_BLOCK).agg(F.sum("begins").alias("n"))
    blocks = _with_sum_before(blocks, "n", "records_before").drop("n")
    so_far = Window.partitionBy(*_BLOCK).orderBy("line")
    parts = materialize(
        parts.join(blocks, _BLOCK).withColumn(
            "record", F.col("records_before") + F.sum("begins").over(so_far)
        ),
        "parts-of-records",
    )
    key = ["file", "record"]
    sizes = materialize(parts.groupBy(*key).agg(F.count("*").alias("n")), "record-sizes")
    fits = F.col("n") <= most_lines
    joined = F.transform(
        F.array_sort(F.collect_list(F.struct("line", "value"))), lambda part: part["value"]
    )
    several = (
        parts.join(sizes.where(fits), key)
        .groupBy(*key)
        .agg(
            F.min("line").alias("line"),
            F.array_join(joined, "\n").alias("value"),
            (F.sum("quotes") % 2 == 0).alias("whole"),
        )
        .select("file", "line", "value", "whole")
    )
    too_long = parts.join(sizes.where(~fits), key).select(
        "file", "line", "value", F.lit(False).alias("whole")
    )
    ended = F.regexp_replace("value", "\r$", "")
    found = single.unionByName(several).unionByName(too_long).withColumn("value", ended)
    return found.where("value <> ''")
