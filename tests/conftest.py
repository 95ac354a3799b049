import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("QUILLSCAN_MASTER", "local[4]")
    os.environ.setdefault("QUILLSCAN_SHUFFLE_PARTITIONS", "4")
    from quillscan.session import checkpoint_dir, get_session
    s = get_session()
    checkpoint_dir(s)
    yield s
    s.stop()
