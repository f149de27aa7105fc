import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs], DOCS)

    return make


@pytest.fixture
def odd_docs(docs_of):
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long_text = "\n".join(f"word{k % 977} and line number {k} of a very long text" for k in range(6000))
    return docs_of([(1, None), (2, ""), (3, "a"), (3, "a"), (4, long_text), (5, long_text), (None, "a null id"), (6, "   \n\t "), (7, "é ü ▁ 𝒳")])
