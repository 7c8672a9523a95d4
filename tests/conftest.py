import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from leafloom.session import build_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = prepare(build_session("leafloom-tests", 8))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
