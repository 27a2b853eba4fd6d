import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("keyloom-tests")
         .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         # Tiny fixtures: planning and compiling cost more than running.
         .config("spark.sql.adaptive.enabled", "false").config("spark.sql.codegen.wholeStage", "false")
         .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
