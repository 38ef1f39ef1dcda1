import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from daytrace.session import build_session

    session = build_session("tests", cpus="8", shuffle_partitions=4)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
