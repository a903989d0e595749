import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names clash with results."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang if isinstance(lang, str) else lang[n], "s", len(t or ""), "x", "y") for n, (i, t) in enumerate(rows)], SCHEMA)

    return make
