import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomspark.session import local_session

    session = local_session("tests", 4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
