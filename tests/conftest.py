import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marklens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8, "8g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
