import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) rows, over several partitions."""

    def make(rows, parts=3):
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)
        return df.repartition(parts, F.xxhash64("text", "doc_id"))

    return make


def words(rng, n, vocabulary=400):
    return [f"w{int(x)}" for x in rng.integers(0, vocabulary, n)]


#: Nulls, empty and white-space texts, a short one, repeats, non-ASCII, a very long one.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "ÉTÉ straße 日本語 \x01 a\x1cb"), (7, "long " * 30000), (None, "no id at all"), (8, "a\r\nb  c\n\nd e ")]
