"""The two tables, clean and raw, derived from the order-management tables.

Users are all customers and all suppliers; suppliers never place orders, so they
are the registered users who never played.  Facts are all orders, 18 years
later; the largest orders are booked on guest ids that no user table knows.
The raw form is the same rows as text with typing errors, nulls and repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COUNTRY = "case when {0} < 9 then 'CA' when {0} < 15 then 'MX' else 'US' end"
_PLAYER = (
    "concat(case when o_totalprice >= 495000 then 'Guest####' else 'Customer#' end,"
    " lpad(cast(o_custkey as string), 9, '0'))"
)
_EVENT_DAY = "cast(add_months(cast(o_orderdate as date), 216) as date)"
_HOUR = "cast(16 + o_orderkey % 5 as int)"
_POINTS = "cast(floor(o_totalprice / 100) as int) - 2500"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz"
    return spark.read.schema(schema).parquet(f"{sf_dir}/orders.parquet")


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = (
        spark.read.schema("c_name string, c_acctbal double, c_nationkey int")
        .parquet(f"{sf_dir}/customer.parquet")
        .toDF("userid", "balance", "nation")
    )
    suppliers = (
        spark.read.schema("s_name string, s_acctbal double, s_nationkey int")
        .parquet(f"{sf_dir}/supplier.parquet")
        .toDF("userid", "balance", "nation")
    )
    return customers.union(suppliers)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir).selectExpr(
        "userid",
        "cast(balance >= 8000 as int) as subscriber",
        f"{_COUNTRY.format('nation')} as country",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr(
        f"{_PLAYER} as userid",
        f"{_EVENT_DAY} as event_date",
        f"{_HOUR} as hour",
        f"{_POINTS} as points",
    )


def staging_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir).selectExpr(
        "explode(sequence(1, case when balance >= 9900 then 2 else 1 end)) as copy",
        "userid",
        "case when balance between 0 and 50 then '2'"
        " else cast(cast(balance >= 8000 as int) as string) end as subscriber",
        "case when balance < -950 then null when balance between 50 and 100 then 'USA'"
        f" else {_COUNTRY.format('nation')} end as country",
    ).drop("copy")


def staging_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _orders(spark, sf_dir).selectExpr(
        "explode(sequence(1, case when o_totalprice >= 499000 then 2 else 1 end)) as copy",
        "o_orderkey % 200 as fault",
        f"{_PLAYER} as player",
        f"{_EVENT_DAY} as day",
        f"{_HOUR} as hour",
        f"{_POINTS} as points",
    )
    return scores.selectExpr(
        "case fault when 1 then concat(player, ' ') when 2 then concat(player, '\"')"
        " when 9 then null else player end as userid",
        "case fault when 3 then '19/24/2019' when 6 then '3/22/99' when 7 then '8/2/39'"
        " when 8 then concat(month(day), '/', day(day), '/', year(day)) when 10 then null"
        " else concat(month(day), '/', day(day), '/', right(cast(year(day) as string), 2)) end"
        " as event_date",
        "case fault when 11 then null when 14 then '27' else cast(hour as string) end as hour",
        "case fault when 4 then concat('\"', points, '\"') when 5 then concat(points, '??')"
        " when 12 then null when 13 then 'n/a' else cast(points as string) end as points",
    )
