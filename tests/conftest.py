import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexloom.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return ship(local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}))
