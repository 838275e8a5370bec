import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tenor.session import ensure_checkpoint_dir, tune

    scratch = tempfile.mkdtemp(prefix="tenor-test-")
    s = (SparkSession.builder.master("local[*]")
         .appName("tenor-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.local.dir", scratch)
         .config("spark.sql.warehouse.dir", os.path.join(scratch, "wh"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s, os.path.join(scratch, "ckpt"))
    tune(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
