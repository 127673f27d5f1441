import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tarmac.schemas import schema  # noqa: E402
from tarmac.session import build_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, app="tarmac-tests", memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """``rows("a:long b:ts", [(1, "2024-01-01 00:00:00")])``; text in a time column is read as ISO time."""

    def make(spec, data):
        target = schema(spec)
        kinds = [f.dataType.typeName() for f in target.fields]
        typed = [
            tuple(datetime.fromisoformat(v) if k == "timestamp_ntz" and isinstance(v, str) else v for k, v in zip(kinds, r))
            for r in data
        ]
        return spark.createDataFrame(typed, target)

    return make


def at(text):
    return datetime.fromisoformat(text)
