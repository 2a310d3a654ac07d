"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("WAYFOLD_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from wayfold.session import local_session

    session = local_session("4", 4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()
