import pytest

from cuelake.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
