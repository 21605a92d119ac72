from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from boxlake.session import local_session

    return local_session("8")


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


@pytest.fixture(scope="session")
def skewed(tmp_path_factory) -> str:
    """The small tables with a third of the rows on one key."""
    from skewed import build

    return build(SMALL, str(tmp_path_factory.mktemp("skewed")))


@pytest.fixture
def tight(monkeypatch):
    """Limits so low that every hot-key path runs on small data."""
    from boxlake import skew

    monkeypatch.setattr(skew, "HOT_JOIN_ROWS", 50)
    return skew
