import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (str(ROOT), os.environ.get("PYTHONPATH", "")) if p)


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    s = local_session(4, "tests")
    yield s
    s.stop()
