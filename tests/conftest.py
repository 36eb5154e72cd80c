import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import ship

    session = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


SF = "/root/testdata/sf0.001"
