import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("rarelabel-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def classes(spark):
    """Make ``(id, label)`` rows with the given class sizes."""
    from pyspark.sql import functions as F

    def make(*sizes):
        edges, total = [], 0
        for n in sizes:
            total += n
            edges.append(total)
        label = F.lit(0)
        for i, edge in reversed(list(enumerate(edges))):
            label = F.when(F.col("id") < edge, i).otherwise(label)
        return spark.range(total).select("id", label.alias("label"))

    return make
