import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import get_session

    s = get_session("local[4]", shuffle_partitions=8, app_name="cohortlens-tests")
    yield s
    s.stop()
