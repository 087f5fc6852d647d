import pytest

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """``make_docs([(id, text), ...])``: a table with the columns of ``documents``."""
    def make(rows, extra=None):
        full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        for c in extra or ():
            df = df.selectExpr("*", f"'x' AS `{c}`")
        return df
    return make
