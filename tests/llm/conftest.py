import pytest

DOCUMENTS = "doc_id long, text string, source string, digest string, size long, score double"


@pytest.fixture(scope="session")
def documents(spark):
    """Make documents with clashing extra columns from (doc_id, text[, source]) rows."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 7, 0.5) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def real(spark):
    """The smallest documents table, as rows."""
    from conftest import SF001
    return [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "source").collect()]
