import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.testing import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
