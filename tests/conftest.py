import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("shopfloor-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def whole(spark):
    """The settings of a run as it comes: chunks of a million rows, broadcasts where the planner likes."""
    spark.conf.unset("shopfloor.chunkRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def spread(spark, chunk_rows=16):
    """What large inputs bring: many chunks to a group, and no broadcasts."""
    spark.conf.set("shopfloor.chunkRows", str(chunk_rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


@pytest.fixture(params=["whole", "spread"])
def mode(request, spark):
    """Run a test with whole groups in a chunk, and again with groups cut into many."""
    if request.param == "spread":
        spread(spark)
    yield request.param
    whole(spark)
