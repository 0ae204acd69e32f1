import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (or (id, text) pairs), with a column whose name the operators use themselves."""

    def make(texts, **extra):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)
        return df.selectExpr("*", "'x' AS words", "1 AS node", "2 AS label")

    return make

