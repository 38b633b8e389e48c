import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from siftlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", app="siftlake-tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
