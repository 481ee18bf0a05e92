import pytest

from brindle.session import default_session


@pytest.fixture(scope="session")
def spark():
    return default_session("4", **{"spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "4"})
