import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from quirework.session import local_session

    session = local_session(cores=4, memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
