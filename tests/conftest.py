import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import local_session

    warehouse = tempfile.mkdtemp(prefix="tallyloom-warehouse-")
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": warehouse})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
