import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trackmesh.session import session

    conf = {"spark__ui__enabled": "false", "spark__driver__memory": "6g", "spark__checkpoint__dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    found = session("tests", "local[8]", 8, **conf)
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF
