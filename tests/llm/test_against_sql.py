from __future__ import annotations

import pytest

from checks.compare import difference
from scorewright.llm.queries import oracle_sql, queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_sql(spark, small_oracle, name):
    assert difference(queries()[name](spark, SMALL), small_oracle, oracle_sql()[name]) is None


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries()) == list(range(1, 14))
