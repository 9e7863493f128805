"""Profiling and validation of raw rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from scorewright.sources.storage import materialize, new_path


def rows_with_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that miss a value in any of the columns."""
    return df.where(reduce(or_, [F.col(c).isNull() for c in columns or df.columns]))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("num_records")).where("num_records > 1")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Non-null values of one key that occur more than once."""
    return (
        df.groupBy(F.col(key).alias("duplicate_ids"))
        .agg(F.count(key).alias("num_records"))
        .where("num_records > 1")
    )


def length_histogram(df: DataFrame, column: str) -> DataFrame:
    """Number of rows per text length."""
    return df.groupBy(F.length(column).alias(f"{column}_length")).agg(
        F.count("*").alias("frequency")
    )


def distinct_values(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.select(value.alias(name)).distinct()


def longest_values(df: DataFrame, column: str) -> DataFrame:
    """All rows' values whose length equals the longest length of the column."""
    length = F.length(column)
    longest = df.agg(F.max(length).alias("longest")).scalar()
    return df.where(length == longest).select(column, length.alias(f"{column}_length"))


def failed_casts(df: DataFrame, column: str, parsed: Column) -> DataFrame:
    """Rows with a value in ``column`` that ``parsed`` could not turn into the target type."""
    return df.where(F.col(column).isNotNull() & parsed.isNull())


def first_failed_cast(df: DataFrame, column: str, parsed: Column) -> DataFrame:
    """The first value in file order that ``parsed`` could not turn into the target type.

    ``df`` has the ``file`` and ``line`` of its rows (``load_csv_lines`` with positions).
    """
    failed = failed_casts(df, column, parsed).select("file", "line", column)
    return failed.orderBy("file", "line").limit(1)


@dataclass(frozen=True)
class Rule:
    """A named row rule; ``violated`` is true for rows that break it."""

    name: str
    violated: Column


def not_null(*columns: str) -> list[Rule]:
    return [Rule(f"{c}_not_null", F.col(c).isNull()) for c in columns]


def in_set(column: str, values: Sequence) -> Rule:
    return Rule(f"valid_{column}", ~F.col(column).isin(*values))


def in_range(column: str, low, high) -> Rule:
    return Rule(f"valid_{column}", ~F.col(column).between(low, high))


def max_length(column: str, length: int) -> Rule:
    return Rule(f"{column}_max_length", F.length(column) > length)


def compute_once(df: DataFrame) -> DataFrame:
    """The same rows, with the columns fixed as computed here.

    A filter on a computed column is otherwise moved below the computation, which then
    runs once per mention.  Filters do not move below a generator.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _broken(rule: Rule) -> Column:
    return F.coalesce(rule.violated, F.lit(False))


def _with_copies(df: DataFrame, key: str) -> DataFrame:
    """Add the number of rows of each repeated key; NULL for keys that occur once.

    The repeated keys are written: with a plain scan on each side, adaptive execution can
    split the rows of a key that occurs very often.
    """
    repeated = materialize(
        df.groupBy(key)
        .agg(F.count("*").alias("_copies"))
        .where(F.col(key).isNotNull() & (F.col("_copies") > 1)),
        "repeated-keys",
    )
    return df.join(repeated, key, "left").select(*df.columns, "_copies")


def _prepare(
    df: DataFrame, rules: Sequence[Rule], unique: str | None
) -> tuple[DataFrame, list[Rule]]:
    if unique is None:
        return df, list(rules)
    return _with_copies(df, unique), [*rules, Rule(f"{unique}_unique", F.col("_copies") > 1)]


def _names(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(r.violated, F.lit(r.name)) for r in rules]))


def flag(
    df: DataFrame, rules: Sequence[Rule], unique: str | None = None, helpers: Sequence[str] = ()
) -> DataFrame:
    """Every row, with the names of the rules it breaks in ``failed_rules``.

    A null passes a rule unless the rule is about nulls.  With ``unique`` every copy of a
    repeated key breaks a rule.  ``helpers`` are columns for the rules alone; they go.
    """
    rows, all_rules = _prepare(df, rules, unique)
    kept = [name for name in df.columns if name not in helpers]
    return rows.select(*kept, _names(all_rules).alias("failed_rules"))


def split_flagged(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows of a flagged table, and the rejected ones with their reasons."""
    fine = F.size("failed_rules") == 0
    return flagged.where(fine).drop("failed_rules"), flagged.where(~fine)


class Written(NamedTuple):
    """The two parts of a written table, and the counts taken by the write itself."""

    valid: DataFrame
    rejected: DataFrame
    counts: dict[str, int]

    def row_account(self, spark: SparkSession) -> DataFrame:
        """(outcome, num_rows): valid and rejected rows, and those in neither part."""
        n = self.counts
        rest = n["all"] - n["valid"] - n["rejected"]
        rows = [("valid", n["valid"]), ("rejected", n["rejected"]), ("unaccounted", rest)]
        return spark.createDataFrame(rows, "outcome string, num_rows long")

    def rejection_counts(self, spark: SparkSession) -> DataFrame:
        """Number of rejected rows per rule that was broken."""
        marked = [(k.removeprefix(_RULE), n) for k, n in self.counts.items() if k.startswith(_RULE) and n]
        return spark.createDataFrame(marked, "rule string, num_rows long")


_RULE = "rule:"


def write_split(flagged: DataFrame, label: str, rules: Sequence[str] = ()) -> Written:
    """The valid and the rejected rows, written in one pass as two parts of the shared folder.

    The same pass counts both, and the rows that break each of the named rules.
    """
    spark, path = flagged.sparkSession, new_path(flagged.sparkSession, label)
    marked = flagged.withColumn("valid", F.size("failed_rules") == 0)
    counted = Observation()
    (
        marked.observe(
            counted,
            F.count("*").alias("all"),
            F.count_if("valid").alias("valid"),
            F.count_if(~F.col("valid")).alias("rejected"),
            *[F.count_if(F.array_contains("failed_rules", r)).alias(f"{_RULE}{r}") for r in rules],
        )
        .write.partitionBy("valid")
        .parquet(path)
    )
    rows = spark.read.schema(marked.schema).parquet(path)
    return Written(
        rows.where("valid").drop("valid", "failed_rules"),
        rows.where("NOT valid").drop("valid"),
        dict(counted.get),
    )


def validate(
    df: DataFrame, rules: Sequence[Rule], unique: str | None = None, helpers: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejected ones with the names of the rules they break.

    A caller that needs both parts writes the flagged rows once and splits what it reads.
    """
    return split_flagged(compute_once(flag(df, rules, unique, helpers)))


def require(df: DataFrame, rules: Sequence[Rule], unique: str | None = None) -> DataFrame:
    """The same rows, failing the job at the first row that breaks a rule."""
    rows, all_rules = _prepare(df, rules, unique)
    broken = reduce(or_, [_broken(rule) for rule in all_rules])
    message = F.concat(F.lit("row violates "), F.array_join(_names(all_rules), ", "))
    return rows.where(
        F.when(broken, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    ).select(*df.columns)


def rejection_counts(rejected: DataFrame) -> DataFrame:
    """Number of rejected rows per broken rule."""
    return (
        rejected.select(F.explode("failed_rules").alias("rule"))
        .groupBy("rule")
        .agg(F.count("*").alias("num_rows"))
    )
