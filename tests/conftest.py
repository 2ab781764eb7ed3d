import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from strandline.session import build, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship(build("tests", "local[4]", 4))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
