import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# the tests' own engines are made by workers
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from parlance.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
