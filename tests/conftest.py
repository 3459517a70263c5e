import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from modspark import session

    s = session.build(cpus=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    session.release()
    s.stop()
