from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from helixframe.session import local_session

    return local_session("8", **{"spark.driver.memory": "8g"})


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
