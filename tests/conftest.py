import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from voxtree.session import get_session

    return get_session("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).is_dir():
        pytest.skip("no test tables here")
    return DATA
