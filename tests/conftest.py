import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lectern.session import build

    session = build("local[4]", partitions=4, memory="3g", app="tests")
    yield session
    session.stop()
