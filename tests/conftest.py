import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from skein.session import local_session

    with tempfile.TemporaryDirectory(prefix="spark-") as folder:
        session = local_session("tests", "8", spark__checkpoint__dir=folder)
        yield session
        session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL
