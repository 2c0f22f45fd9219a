import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from loomspan.session import local_session  # noqa: E402

DATA = os.environ.get("LOOMSPAN_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, memory="4g")


@pytest.fixture(scope="session")
def data_dir():
    return f"{DATA}/sf0.001"
