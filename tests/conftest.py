import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tickframe.session import local_session

    session = local_session("4", "tickframe-tests", "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def incidents(spark):
    from tickframe.sources import testtables as tt

    df = tt.incidents(spark, SF).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def snapshot(spark):
    from tickframe.sources import testtables as tt

    df = tt.breach(spark, SF).cache()
    df.count()
    return df
