from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusloom.packaging import ship  # noqa: E402
from corpusloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session("tests", cores=8))
    yield session
    session.stop()
