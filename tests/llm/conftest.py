import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from texts (or (doc_id, text) pairs), with extra, clashing columns."""

    def make(texts, first=0):
        rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
        rows = [(d, t, "en", "src0", len(t or ""), "x", 1) for d, t in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, shard int"
        ).repartition(3)

    return make
