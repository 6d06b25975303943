import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from skyledger.session import DEFAULT_CONF
    b = SparkSession.builder.master("local[*]").appName("skyledger-tests") \
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():   # tests set their own only where unset
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skyledger-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="skyledger-test-")
