import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from limnos.session import checkpoint_dir, local_session

    s = local_session(cpus="*", shuffle_partitions=8, app="limnos-tests")
    checkpoint_dir(s)  # unset in tests: a fresh local folder is registered
    yield s
    s.stop()


def rows(spark, data, schema="tds double, turbidity double, ph double"):
    return spark.createDataFrame(data, schema)
