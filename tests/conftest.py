import os
import sys
import tempfile

import pytest
from hypothesis.configuration import set_hypothesis_home_dir

set_hypothesis_home_dir(tempfile.mkdtemp(prefix="hypothesis-"))

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from portolan.session import build_session

    return build_session("tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "10m"})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
