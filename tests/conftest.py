import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from recframe.session import get_session, checkpoint_dir
    s = get_session("local[4]", 4, driver_memory="8g")
    checkpoint_dir(s)
    yield s


SF = "/root/testdata/sf0.001"
