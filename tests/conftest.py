import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from changeflow.session import build_session, checkpoint_dir
    s = build_session("local[*]", app="changeflow-tests", shuffle_partitions=8,
                      conf={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="cf-tests-"),
                            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="cf-wh-")})
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
