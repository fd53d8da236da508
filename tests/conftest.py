import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from specsift.session import ensure_checkpoint_dir, get_spark

    s = get_spark(cores="*", shuffle_partitions=8, app="specsift-tests")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="specsift-test-", dir="/tmp")
