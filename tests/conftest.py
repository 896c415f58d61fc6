import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from weekcraft.session import build_session
    s = build_session("local[4]", 4, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="weekcraft-test-")})
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    from weekcraft.sources.tables import Tables
    return Tables(spark, SF_SMALL)
