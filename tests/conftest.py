from __future__ import annotations

import pytest

from tarnwell.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def settings(spark):
    """Set session options for one test and put them back afterwards."""
    before = {}

    def set_option(name: str, value: str) -> None:
        before.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield set_option
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)
