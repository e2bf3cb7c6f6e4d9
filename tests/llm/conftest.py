import pytest

from kinweave.llm.store import keep

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, record string, `score` double, shard int"


@pytest.fixture(scope="session")
def stored(spark):
    """Rows (doc_id, text) as a stored table with more columns, some named like columns the operators add."""

    def make(rows):
        return keep(spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), 7, "x", 0.5, 3) for d, t in rows], DOCS).coalesce(2), "test")

    return make
