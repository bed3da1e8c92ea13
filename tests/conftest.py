import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tollbridge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tollbridge-tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    yield session
    session.stop()


@pytest.fixture
def setting(spark):
    """Set session settings for one test."""
    changed = []

    def put(key, value):
        changed.append(key)
        spark.conf.set(key, str(value))

    yield put
    for key in changed:
        spark.conf.unset(key)


def rows(df, *order):
    columns = order or df.columns
    return [tuple(r) for r in df.orderBy(*columns).collect()]
