"""Clean tables stored for the jobs that follow: in buckets by user, in folders by month.

Facts and users share their buckets, so joins and groups by user read them as they lie and
shuffle nothing.  A bucket is read by one task, so the users with more than their share of
all rows (more than one bucket's worth on average, hence fewer users than buckets) are kept
apart in a plain table, whose join is split or broadcast as its size asks for.  Both parts
of the facts lie in one folder per month; a period lists only the folders it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from scorewright.functions.dates import month_start
from scorewright.sources.storage import materialize, new_table

KEY, DAY, MONTH = "userid", "event_date", "event_month"


def write_table(
    df: DataFrame, label: str, buckets: int = 0, key: str = KEY, folders: str | None = None
) -> DataFrame:
    """Write a table of the shared folder, in buckets of a key and folders of a column if asked.

    Rows are dealt by the key first, so that a bucket is one file in each folder.
    """
    name, place = new_table(df.sparkSession, label)
    rows = df.repartition(buckets, key) if buckets else df
    writer = rows.write.option("path", place)
    if folders:
        writer = writer.partitionBy(folders)
    if buckets:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


@dataclass(frozen=True)
class ByUser:
    """Stored facts and users; those of the heaviest users apart.  Facts have ``event_month``."""

    facts: DataFrame
    users: DataFrame
    heavy_facts: DataFrame
    heavy_users: DataFrame

    def each_part(self, job: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """A job on facts and users that treats each user alone, over both parts."""
        return job(self.facts, self.users).unionByName(job(self.heavy_facts, self.heavy_users))

    def all_facts(self) -> DataFrame:
        return self.facts.unionByName(self.heavy_facts)

    def period(self, first: date, last: date) -> DataFrame:
        """Facts of the days from first to last, from the folders of their months."""
        return self.all_facts().where(in_period(first, last))


def in_period(first: date, last: date):
    """Condition for the days from first to last that also names the months' folders."""
    days = F.col(DAY).between(F.lit(first), F.lit(last))
    return days & F.col(MONTH).between(F.lit(first.replace(day=1)), F.lit(last.replace(day=1)))


def store_by_user(facts: DataFrame, users: DataFrame, buckets: int | None = None) -> ByUser:
    """Write clean facts (no null ids) and users, in as many buckets as a shuffle has partitions."""
    spark = facts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dated = facts.withColumn(MONTH, month_start(F.col(DAY)))
    per_user = materialize(facts.groupBy(KEY).agg(F.count("*").alias("rows")), "rows-per-user")
    share = per_user.agg(F.sum("rows") / buckets).scalar()
    heavy = materialize(per_user.where(F.col("rows") > share).select(KEY), "heavy-users")
    return ByUser(
        write_table(dated.join(heavy, KEY, "left_anti"), "facts", buckets, folders=MONTH),
        write_table(users.join(heavy, KEY, "left_anti"), "users", buckets),
        write_table(dated.join(heavy, KEY, "left_semi"), "heavy_facts", folders=MONTH),
        write_table(users.join(heavy, KEY, "left_semi"), "heavy_users"),
    )
