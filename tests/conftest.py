import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from kindred.session import local_session

    session = local_session(8, shuffle_partitions=4, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rated(spark):
    """Builds a ratings table from (user, item, rating) tuples."""

    def build(rows):
        return spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")

    return build
