"""One local session for all tests, with small shuffles."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from libralake.session import local_session

    return local_session(threads=4, driver_memory="4g")
