import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType


@pytest.fixture(scope="session")
def texts(spark):
    def make(rows):
        return spark.createDataFrame(rows, StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())]))

    return make
