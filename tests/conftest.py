import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from lamella.session import local_session  # noqa: E402

DATA = os.environ.get("LAMELLA_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "6g")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA
