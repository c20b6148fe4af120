import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) or (id, text, lang) rows."""

    def make(rows):
        full = [(*r, *[None] * (3 - len(r)), "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def sentence(seed: int, words: int) -> str:
    """Words drawn in a fixed order from a few hundred."""
    out, state = [], seed * 7919 + 17
    for _ in range(words):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{(state >> 8) % 601}")
    return " ".join(out)
