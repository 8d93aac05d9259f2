import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from verisift.session import get_spark, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("4", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("the test tables are not here")
    return str(folder)
