import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package from here, whatever the working directory
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PARCELWISE_DRIVER_MEMORY", "6g")
    from parcelwise.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app="parcelwise-tests")
    yield s
    s.stop()
