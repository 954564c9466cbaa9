"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import get_session, ship_package

    session = get_session("tests", cores=4, **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g"})
    ship_package(session)
    yield session
    session.stop()
