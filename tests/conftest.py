import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import local_session

    return local_session("4", "4", "4g")


@pytest.fixture
def large(spark):
    """Force the plans for large inputs."""
    spark.conf.set("spark.plumbline.smallBytes", "0")
    yield spark
    spark.conf.unset("spark.plumbline.smallBytes")


@pytest.fixture(autouse=True)
def uncached(spark):
    """What a test caches does not count in the next."""
    yield
    spark.catalog.clearCache()
