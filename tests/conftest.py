import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from sigweave import get_session
    from sigweave.session import ship_package

    session = get_session("tests", "local[8]")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session
