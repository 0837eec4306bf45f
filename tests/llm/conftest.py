import pytest
from pyspark.sql import functions as F

AWKWARD = ("text", "keep", "pos", "n", "node", "key", "words", "row", "component", "piece")


@pytest.fixture(scope="session")
def make(spark):
    """Documents (doc_id, text) with extra columns whose names operators might use for themselves."""

    def build(rows, extra=()):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        for name in extra:
            df = df.withColumn(name, F.lit("x"))
        return df

    return build
