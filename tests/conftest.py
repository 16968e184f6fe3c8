import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from ratesift.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                          spark__driver__memory="4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Ratings from (user, item, rating) triples."""
    def build(rows):
        return spark.createDataFrame([(u, i, float(r), 1000 + n) for n, (u, i, r) in enumerate(rows)],
                                     "userId long, itemId long, rating double, ts long")

    return build
