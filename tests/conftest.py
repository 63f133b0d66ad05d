import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedspan.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[*]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def platform(spark):
    from feedspan.sources.platform import Platform

    return Platform(spark, SF)


def rows(df, *order):
    """Collected rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(str(x) for x in t))
