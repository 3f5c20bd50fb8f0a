import pytest

from millrace.plans.registry import Tables
from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("millrace-tests", cpus=8, shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def rows_of():
    def sorted_rows(df):
        return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    return sorted_rows
