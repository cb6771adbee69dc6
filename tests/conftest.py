import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from quill.session import local_session

    s = local_session("tests", cores=4, shuffle_partitions=4)
    yield s
    s.stop()
