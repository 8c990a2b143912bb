import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from lintlake.session import local_session

    s = local_session("4", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
