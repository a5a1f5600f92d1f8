import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewire import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[8]", "tidewire-tests", 8, spark__driver__memory="8g")
    yield s
    s.stop()
