import pytest
from corpus_rows import messy_rows
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that the operators use inside
        T.StructField("digest", T.StringType()),
        T.StructField("hash", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("text_digest", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
