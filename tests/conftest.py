import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cuefold.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("cuefold-tests", cpus=4, spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
