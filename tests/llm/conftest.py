import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents_of(spark):
    """Rows of (doc_id, text) as documents with more columns, some under names the operators use inside."""

    def make(rows):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        clashing = {c: F.lit(c) for c in ("word", "label", "print", "c", "head", "at", "key", "chunk", "n", "payload", "votes")}
        return frame.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **clashing})

    return make


EDGES = [(None, "a text without id"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "x" * 300_000), (6, "many words " * 20_000)]
