import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marlstone.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session
