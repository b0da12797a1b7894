from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import make_spark  # noqa: E402

from medialog.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = configure(make_spark())
    yield session
    session.stop()


@pytest.fixture
def scratch(tmp_path, spark):
    """A folder of this test alone."""
    return str(tmp_path)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)
