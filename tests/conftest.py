import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pipewatch.session import local_session

    session = local_session("tests", cores=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_DIR


@pytest.fixture
def split_hot_keys(spark):
    """Keep every range a chunk of its own, and let files be cut after every row elsewhere."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows_of(df, *order):
    """Rows as tuples, sorted for comparison."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))
