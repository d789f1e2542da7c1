import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with clashing extra columns from (doc_id, text) rows, over several partitions."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({"key": F.lit("x"), "n": F.lit(1), "hash": F.lit(2.0), "words": F.lit(None).cast("string"), "node": F.lit(3), "data": F.lit("y")}).repartition(3)

    return make
