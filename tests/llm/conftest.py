import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make(spark):
    def build(rows, schema=DOCS):
        """rows: (doc_id, text[, lang[, source]])"""
        if schema is DOCS:
            rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(rows, schema).repartition(3)
    return build


def rows_of(df):
    return [tuple(r) for r in df.collect()]
