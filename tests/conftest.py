import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("sessionmine-tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column builder on literal strings."""
    from pyspark.sql import functions as F

    def run(build, *values):
        row = spark.createDataFrame([tuple(values)], ", ".join(
            f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
        return row.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]

    return run
