import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, score double, token string, slot int"


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text[, source]) rows, with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 1, 0.5, "t", 3) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "same text"), (5, "same text"), (5, "same text"), (None, "same text"), (7, "word " * 30_000), (8, "é\U0001f600 text"), (9, "x" * 60_000)]
