from __future__ import annotations

import pytest

from checks.compare import local_session, oracle_connection

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_oracle():
    connection = oracle_connection(SMALL)
    yield connection
    connection.close()
