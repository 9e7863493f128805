"""Every job against its SQL text, and the shape of its plan."""

from __future__ import annotations

import pytest

import __spark_entry__
from checks.compare import difference
from checks.oracle import oracle_sql
from scorewright.plans.registry import jobs
from tests.conftest import SMALL

JOBS = jobs()
TEXTS = oracle_sql()


def test_every_job_has_a_text():
    assert set(JOBS) == set(TEXTS)


@pytest.mark.parametrize("name", list(JOBS))
def test_job_matches_sql(spark, small_oracle, name):
    result = JOBS[name](spark, SMALL)
    assert difference(result, small_oracle, TEXTS[name]) is None
    plan = result._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan


def test_entry(spark):
    result = __spark_entry__.entry(spark)
    assert result.columns == ["userid", "month", "points_earned", "ranking"]
    assert result.count() >= 24
