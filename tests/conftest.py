import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def small_blocks(monkeypatch):
    """Cut series into blocks of a few rows, so that small frames cross borders."""
    from tidemark.operators import layout

    def use(rows, halo=None):
        monkeypatch.setattr(layout, "BLOCK_ROWS", rows)
        monkeypatch.setattr(layout, "HALO_ROWS", halo or rows)

    return use
