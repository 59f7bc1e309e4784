import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from inkwright.sources.tables import local_session

    s = local_session("tests", 4, **{"spark.driver.memory": "3g"})
    yield s
    s.stop()
