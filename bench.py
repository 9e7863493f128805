"""Time the headline jobs at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data folder, BENCH_CPUS
(default 8) the number of local cores, BENCH_QUERIES an optional list of jobs
("all" for every job).  All jobs run once to warm up, then once timed.

BENCH_FACTS asks for a scale run: the orders of the folder are repeated under new keys
up to so many rows, a third of them booked on one customer, and written once.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.compare import local_session
from scorewright.plans.registry import jobs
from scorewright.sources.storage import new_path

HEADLINE = """
    q02_participating_players q07_duplicate_facts q12_longest_ids q13_unparseable_dates
    q16_first_next_to_last_dates q21_clean_users q22_clean_facts q26_ghost_rows
    q30_points_summary q34_profile_frequencies q36_enriched_facts q37_participants_by_status
    q39_points_share_by_attribute q42_sign_class_frequencies q43_monthly_activity
    q45_monthly_points_of_positive_users q49_season_hour_totals q51_extreme_days
    q52_top_players_per_month q56_user_totals q57_box_stats q61_residuals
    q62_probability_plot q63_anova q66_multiple_regression q69_chi_square
"""


def _run(result: DataFrame) -> None:
    """Evaluate every row and column without moving them to the driver."""
    result.write.format("noop").mode("overwrite").save()


def _seconds(spark: SparkSession, job, sf_dir: str) -> float:
    start = time.perf_counter()
    _run(job(spark, sf_dir))
    return time.perf_counter() - start


def _enlarged(spark: SparkSession, sf_dir: str, n: int) -> str:
    """A folder with about ``n`` orders, a third of them of one customer."""
    folder = new_path(spark, f"bench-sf{n}")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    times = -(-n // orders.count())
    copies = orders.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    key = F.col("o_orderkey") * times + F.col("copy")
    customer = F.when(F.xxhash64(key) % 3 == 0, F.lit(7)).otherwise(F.col("o_custkey"))
    copies.repartition(32).withColumns({"o_orderkey": key, "o_custkey": customer}).drop(
        "copy"
    ).write.parquet(f"{folder}/orders.parquet")
    for name in ("customer", "supplier"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    all_jobs = jobs()
    chosen = os.environ.get("BENCH_QUERIES", HEADLINE).split()
    names = list(all_jobs) if chosen == ["all"] else chosen
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    facts = int(os.environ.get("BENCH_FACTS", "0"))
    scale = re.search(r"sf([\d.]+)", sf_dir)
    if facts:
        sf_dir = _enlarged(spark, sf_dir, facts)
    for name in names:
        _run(all_jobs[name](spark, sf_dir))
    timings = {name: round(_seconds(spark, all_jobs[name], sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_job_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
                **({"facts": facts} if facts else {}),
            }
        )
    )


if __name__ == "__main__":
    main()
