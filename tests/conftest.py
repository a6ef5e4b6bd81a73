import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from termloom import registry  # noqa: E402
from termloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "8")


@pytest.fixture(scope="session")
def index(spark):
    return registry.corpus_index(spark, SF)
