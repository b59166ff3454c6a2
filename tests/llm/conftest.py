import pytest

from podium.llm.common import prepare_workers

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with the given (doc_id, text[, lang[, source]]) rows."""
    prepare_workers(spark)

    def make(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None) + (0,) * len(extra) for r in rows]
        return spark.createDataFrame(full, DOC + "".join(f", {c} int" for c in extra))
    return make
