"""One player holds a third of all rows, no side is small enough to broadcast."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks.compare import difference, oracle_connection
from checks.oracle import oracle_sql
from scorewright.operators import quality
from scorewright.plans.registry import jobs

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
}

NAMES = """
    q07_duplicate_facts q21_clean_users q21_rejected_users q24_matched_ids q25_ghost_ids
    q26_ghost_rows q36_enriched_facts q37_participants_by_status q39_points_share_by_attribute
    q42_sign_class_frequencies q43_monthly_activity q45_monthly_points_of_positive_users
    q47_class_changes q52_top_players_per_month q53_rows_per_level q56_user_totals q57_box_stats
    q58_top_outliers q62_probability_plot q67_classified_facts q67_positive_facts
    q68_class_row_shares q68_users_with_positive_facts q68_users_with_negative_facts q69_contingency_table
""".split()


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("uneven")
    orders = spark.range(0, 30_000, 1, 6).selectExpr(
        "id as o_orderkey",
        "case when hash(id) % 3 = 0 then 7L else pmod(xxhash64(id), 3000) end as o_custkey",
        "1000 + pmod(xxhash64(id, 1), 49900000) / 100.0D as o_totalprice",
        "cast(date_add(date'1995-01-01', cast(pmod(xxhash64(id, 2), 2400) as int))"
        " as timestamp_ntz) as o_orderdate",
    )
    accounts = (
        "pmod(xxhash64(id, 4), 1100000) / 100.0D - 1000 as {0}_acctbal",
        "cast(pmod(xxhash64(id, 3), 25) as int) as {0}_nationkey",
    )
    tables = {
        "orders": orders,
        "customer": spark.range(3000).selectExpr(
            "concat('Customer#', lpad(cast(id as string), 9, '0')) as c_name",
            *[a.format("c") for a in accounts],
        ),
        "supplier": spark.range(300).selectExpr(
            "concat('Supplier#', lpad(cast(id as string), 9, '0')) as s_name",
            *[a.format("s") for a in accounts],
        ),
    }
    for name, frame in tables.items():
        frame.write.parquet(str(folder / f"{name}.parquet"))
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    connection = oracle_connection(str(folder))
    yield str(folder), connection
    connection.close()
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", NAMES)
def test_job_on_skewed_tables(spark, skewed, name):
    folder, connection = skewed
    assert difference(jobs()[name](spark, folder), connection, oracle_sql()[name]) is None


def _joins_that_ran(spark, folder, name):
    result = jobs()[name](spark, folder)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "SortMergeJoin" in line]


SPLIT = """
    q36_enriched_facts q67_classified_facts q67_positive_facts q68_users_with_positive_facts
    q68_users_with_negative_facts
""".split()


@pytest.mark.parametrize("name", SPLIT)
def test_the_hot_player_is_split(spark, skewed, name):
    assert any("skew=true" in join for join in _joins_that_ran(spark, skewed[0], name))


def test_without_the_settings_nothing_is_split(spark, skewed):
    key = "spark.sql.adaptive.skewJoin.enabled"
    spark.conf.set(key, "false")
    try:
        joins = _joins_that_ran(spark, skewed[0], "q67_positive_facts")
    finally:
        spark.conf.unset(key)
    assert joins and not any("skew=true" in join for join in joins)


def test_rows_of_a_hot_repeated_key_are_split(spark, skewed):
    users = spark.range(0, 60_000, 1, 6).selectExpr(
        "case when id % 3 = 0 then 'same' else cast(id as string) end as userid", "sha2(cast(id as string), 256) as note"
    )
    users.write.parquet(f"{skewed[0]}/repeats")
    flagged = quality.flag(spark.read.parquet(f"{skewed[0]}/repeats"), [], unique="userid")
    assert flagged.where(F.size("failed_rules") > 0).count() == 20_000
    flagged.collect()
    assert "skew=true" in flagged._jdf.queryExecution().executedPlan().toString()
