import pytest
from pyspark.sql import SparkSession

from opinara.session import BUILD_SETTINGS, configure


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("opinara-tests")
        .config(map=BUILD_SETTINGS).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def evaluate_text(spark):
    """Value of a column function for each of some texts."""
    from pyspark.sql import functions as F

    def run(function, values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [r["x"] for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]

    return run
