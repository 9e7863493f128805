"""Loading, profiling and cleaning jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorewright.functions.text import has_illegal_chars, show_spaces, truncate
from scorewright.operators import cleaning, quality, ranking
from scorewright.plans.inputs import Inputs
from scorewright.sources import schemas, tables
from scorewright.sources.csv_files import export_csv, load_csv, load_csv_lines
from scorewright.sources.storage import new_path, new_table


def s01_load_users_csv(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "users-csv")
    export_csv(t.staging_users, path)
    return load_csv(t.spark, path, schemas.staging_users(t.attribute))


def s01_line_breaks_in_quotes(t: Inputs) -> DataFrame:
    """Users whose ids hold line breaks, quotes and commas, written and loaded again."""
    path = new_path(t.spark, "users-csv")
    broken = F.concat("userid", F.lit('\n"x",\n'), F.coalesce(t.attribute, F.lit("")))
    rows = t.staging_users.withColumn(
        "userid", F.when(F.col("subscriber") == "1", broken).otherwise(F.col("userid"))
    )
    export_csv(rows, path)
    return load_csv_lines(t.spark, path, schemas.staging_users(t.attribute))[0]


def s02_load_facts_csv(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "facts-csv")
    export_csv(t.staging_facts, path)
    return load_csv(t.spark, path, schemas.staging_facts())


def s02_malformed_lines(t: Inputs) -> DataFrame:
    """Facts as text, with lines that have a field too many or too few."""
    path = new_path(t.spark, "ragged-csv")
    day = F.date_format("event_date", "yyyy-MM-dd")
    line = F.concat_ws(",", "userid", day, "hour", "points")
    ragged = (
        F.when(F.col("points") % 50 == 0, F.concat(line, F.lit(",x")))
        .when(F.col("points") % 50 == 1, F.concat_ws(",", "userid", day, "hour"))
        .otherwise(line)
    )
    t.facts.select(ragged.alias("value")).write.text(path)
    return load_csv_lines(t.spark, path, schemas.staging_facts(), header=False)[1]


def s03_replace_staging_table(t: Inputs) -> DataFrame:
    return tables.replace_table(t.staging_users, *new_table(t.spark, "users_staging"))


def s06_sql_with_dates(t: Inputs) -> DataFrame:
    t.dated_facts.createOrReplaceTempView("event_performance_dated")
    return tables.run_query(
        t.spark,
        "SELECT COUNT(*) AS num_rows, date_format(event_date, 'yyyy-MM-dd') AS event_date"
        " FROM event_performance_dated WHERE event_date IS NOT NULL GROUP BY event_date",
        index_columns=["event_date"],
        date_columns=["event_date"],
    )


def s07_persisted_step(t: Inputs) -> DataFrame:
    name, location = new_table(t.spark, "dated_facts")
    return tables.run_step(
        cleaning.normalise_dates, t.staging_facts, table=name, location=location
    )


def s08_insert_select(t: Inputs) -> DataFrame:
    """Staging rows, repaired, into an empty clean table, but for those that break a rule."""
    name, location = new_table(t.spark, "event_performance")
    tables.replace_table(t.spark.createDataFrame([], schemas.clean_facts()), name, location)
    return tables.insert_select(
        t.flagged_facts(),
        name,
        ["points", "hour", "event_date", "userid"],
        where=F.size("failed_rules") == 0,
    )


def q04_users_with_nulls(t: Inputs) -> DataFrame:
    return quality.rows_with_nulls(t.staging_users)


def q05_facts_with_nulls(t: Inputs) -> DataFrame:
    return quality.rows_with_nulls(t.staging_facts)


def q06_duplicate_users(t: Inputs) -> DataFrame:
    return quality.duplicate_keys(t.staging_users, "userid")


def q07_duplicate_facts(t: Inputs) -> DataFrame:
    return quality.duplicates(t.staging_facts, ["userid", "event_date", "hour", "points"])


def q08_user_id_lengths(t: Inputs) -> DataFrame:
    return quality.length_histogram(t.staging_users, "userid")


def q09_subscriber_values(t: Inputs) -> DataFrame:
    return quality.distinct_values(
        t.staging_users, F.col("subscriber").cast("int"), "subscriber"
    )


def q10_attribute_levels(t: Inputs) -> DataFrame:
    width = max(map(len, t.levels))
    return quality.distinct_values(
        t.staging_users, truncate(F.col(t.attribute), width), t.attribute
    )


def q11_fact_id_lengths(t: Inputs) -> DataFrame:
    return quality.length_histogram(t.staging_facts, "userid")


def q12_longest_ids(t: Inputs) -> DataFrame:
    longest = quality.longest_values(t.staging_facts, "userid")
    return longest.withColumn("userid", show_spaces(F.col("userid")))


def q13_unparseable_dates(t: Inputs) -> DataFrame:
    return cleaning.split_invalid_dates(t.staging_facts)[1]


def q14_without_invalid_dates(t: Inputs) -> DataFrame:
    kept, _ = cleaning.split_invalid_dates(t.staging_facts)
    return kept


def q15_normalised_dates(t: Inputs) -> DataFrame:
    return t.dated_facts


def q16_first_next_to_last_dates(t: Inputs) -> DataFrame:
    return ranking.first_next_to_last(t.event_dates, "event_date", 3)


def q17_earliest_dates(t: Inputs) -> DataFrame:
    return ranking.first_values(t.event_dates, "event_date", 5, "earliest_dates")


def q17_latest_dates(t: Inputs) -> DataFrame:
    return ranking.last_values(t.event_dates, "event_date", 5, "latest_dates")


def q18_hours(t: Inputs) -> DataFrame:
    hours = quality.distinct_values(t.staging_facts, F.col("hour").cast("int"), "hour")
    return hours.orderBy("hour")


def q19_illegal_points(t: Inputs) -> DataFrame:
    return t.staging_facts.select("points").where(has_illegal_chars(F.col("points")))


def q20_points_failing_cast(t: Inputs) -> DataFrame:
    return quality.failed_casts(t.staging_facts, "points", F.col("points").try_cast("int"))


def q21_clean_users(t: Inputs) -> DataFrame:
    return cleaning.clean_users(t.staging_users, t.levels, t.attribute)[0]


def _rules_as_text(rejected: DataFrame) -> DataFrame:
    return rejected.withColumn("failed_rules", F.array_join("failed_rules", ","))


def q21_rejected_users(t: Inputs) -> DataFrame:
    return _rules_as_text(cleaning.clean_users(t.staging_users, t.levels, t.attribute)[1])


def q22_clean_facts(t: Inputs) -> DataFrame:
    return cleaning.clean_facts(t.staging_facts, t.as_of)[0]


def q22_rejected_facts(t: Inputs) -> DataFrame:
    return _rules_as_text(cleaning.clean_facts(t.staging_facts, t.as_of)[1])


def q22_rejection_counts(t: Inputs) -> DataFrame:
    return quality.rejection_counts(cleaning.clean_facts(t.staging_facts, t.as_of)[1])


def q22_row_account(t: Inputs) -> DataFrame:
    return cleaning.row_account(t.staging_facts, t.flagged_facts())


def q23_exported_facts(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "event-performance-clean")
    export_csv(cleaning.clean_facts(t.staging_facts, t.as_of)[0], path)
    return load_csv(t.spark, path, schemas.clean_facts())
