import pytest

from verify import session


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s
