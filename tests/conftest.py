import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from reelframe.session import build_session, release_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_tables(session)
    session.stop()
