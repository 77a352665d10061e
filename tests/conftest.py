import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN").config("spark.sql.adaptive.enabled", "false").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
