import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from normatile.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(7)
