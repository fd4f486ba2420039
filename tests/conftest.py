import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from mnemos.session import session

    s = session("local[4]", partitions=4, spark__ui__enabled="false", spark__driver__memory="3g", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('checkpoints')}")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
