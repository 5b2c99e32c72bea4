import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ehrflow.session import build_session
    warehouse = tempfile.mkdtemp(prefix="ehrflow-wh-")
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.ui.showConsoleProgress": "false",
                             "spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="ehrflow-test-")
