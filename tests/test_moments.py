from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import encoding, hypothesis, joins, moments, regression

FACTS = "userid string, event_date date, hour int, points int"
USERS = "userid string, subscriber int, country string"
LEVELS = ("CA", "MX", "US")
PROFILE = ("subscriber", "country")


def _facts(rng, n, first, days):
    ids = ["hot" if rng.random() < 0.4 else f"u{rng.randint(0, 40)}" for _ in range(n)]
    return [
        (i, first + timedelta(rng.randrange(days)), 16, None if rng.random() < 0.02 else rng.randint(-900, 2000))
        for i in ids
    ]


def _users(rng, names):
    return [(name, rng.randint(0, 1), rng.choice(LEVELS)) for name in names]


@pytest.fixture(scope="module")
def batches(spark):
    """Three batches of facts, the last with facts of earlier days, and users that register late."""
    rng = random.Random(3)
    early = _users(rng, ["hot", *[f"u{i}" for i in range(30)], "idle"])
    late = _users(rng, [f"u{i}" for i in range(30, 38)])
    facts = [
        _facts(rng, 300, date(2014, 1, 1), 60),
        _facts(rng, 200, date(2014, 3, 1), 40),
        _facts(rng, 200, date(2014, 2, 1), 90) + [(None, date(2014, 2, 2), 16, 7)],
    ]
    frames = [spark.createDataFrame(rows, FACTS) for rows in facts]
    state = moments.start(spark.createDataFrame(early, USERS), frames[0], PROFILE)
    state = state.add(frames[1], spark.createDataFrame(late, USERS)).add(frames[2])
    totals = joins.users_with_totals(
        spark.createDataFrame(early + late, USERS), frames[0].union(frames[1]).union(frames[2])
    )
    return state, totals


def test_batches_add_up_to_the_moments_of_all_totals(batches):
    state, totals = batches
    expected = totals.groupBy(*PROFILE).agg(
        F.count("*").alias("n"),
        F.sum("total_points").alias("points"),
        F.sum(F.col("total_points") * F.col("total_points")).alias("squares"),
    )
    found = state.by(PROFILE)
    assert {tuple(map(str, r)) for r in found.collect()} == {tuple(map(str, r)) for r in expected.collect()}


def test_statistics_agree_with_those_of_the_rows(batches):
    state, totals = batches
    corr = totals.agg(F.corr("total_points", "subscriber")).first()[0]
    assert moments.correlation(state, "subscriber", 12).first()[0] == pytest.approx(corr, rel=1e-9)
    dummies = encoding.one_hot(totals, "country", LEVELS)
    direct = regression.fit_linear(dummies, "total_points", ["subscriber", "country_MX", "country_US"])
    merged = moments.fit_linear(state, "country", LEVELS)
    assert merged.terms == direct.terms and merged.df_residual == direct.df_residual
    assert np.allclose(merged.coefficients, direct.coefficients, rtol=1e-9)
    assert np.allclose(merged.std_errors, direct.std_errors, rtol=1e-9)
    rows = hypothesis.one_way_anova(totals, "total_points", "country").first()
    assert list(moments.one_way_anova(state, "country").first()) == pytest.approx(list(rows), rel=1e-9)


def test_large_totals_keep_their_digits(spark):
    users = spark.createDataFrame([("a", 0, "CA"), ("b", 0, "CA"), ("c", 1, "US")], USERS)
    rows = [(u, date(2014, 1, 1 + i % 3), i, 2_000_000_000) for u in "abc" for i in range(50)]
    state = moments.start(users, spark.createDataFrame(rows, FACTS), PROFILE)
    state = state.add(spark.createDataFrame([("b", date(2014, 1, 9), 1, 3)], FACTS))
    sums = {r["country"]: r for r in state.by(["country"]).collect()}
    assert int(sums["CA"]["squares"]) == (10**11) ** 2 + (10**11 + 3) ** 2
    assert moments.correlation(state, "subscriber").first()[0] == pytest.approx(-0.5, abs=1e-4)


def test_a_batch_reads_its_own_facts_and_written_tables_only(spark, batches):
    state, _ = batches
    read = state.days.inputFiles() + state.totals.inputFiles()
    assert read and all("/moments-" in f or "/totals-so-far-" in f for f in read)


def test_no_facts_and_no_users(spark):
    nobody = moments.start(spark.createDataFrame([], USERS), spark.createDataFrame([], FACTS), PROFILE)
    assert nobody.by(PROFILE).count() == 0
    assert moments.correlation(nobody, "subscriber").first()[0] is None
    assert moments.correlation_by_month(nobody, "subscriber").count() == 0
    idle = moments.start(spark.createDataFrame([("a", 1, None)], USERS), spark.createDataFrame([], FACTS), PROFILE)
    assert [int(x) for x in idle.by(["subscriber"]).first()] == [1, 1, 0, 0]


def test_correlation_at_the_end_of_each_month(spark):
    rng = random.Random(8)
    users = _users(rng, [f"u{i}" for i in range(25)])
    facts = _facts(rng, 150, date(2014, 1, 1), 120)
    state = moments.start(spark.createDataFrame(users, USERS), spark.createDataFrame(facts, FACTS), PROFILE)
    found = {r["month"]: r["correlation"] for r in moments.correlation_by_month(state, "subscriber", 9).collect()}
    assert len(found) == 4
    for month, value in found.items():
        end = (month + timedelta(31)).replace(day=1)
        total = dict.fromkeys((u[0] for u in users), 0)
        for user, day, _, points in facts:
            if user in total and day < end:
                total[user] += points or 0
        expected = np.corrcoef([u[1] for u in users], [total[u[0]] for u in users])[0, 1]
        assert value == pytest.approx(expected, abs=1e-7)
