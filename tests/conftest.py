import os
import sys

import pytest

for folder in ("llm", "."):  # test modules that import each other
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), folder))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def pytest_configure(config):
    """Files of one name in two folders are two modules, also where ``tests`` is no package."""
    config.option.importmode = "importlib"


@pytest.fixture(scope="session")
def spark():
    from tagweave.session import get_session
    s = get_session("local[4]", shuffle_partitions=8, app_name="tagweave-tests")
    yield s
    s.stop()


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
