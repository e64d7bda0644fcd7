import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Builds a documents table of texts, with columns whose names the operators use for their own results."""

    def build(*texts, ids=None, sources=None):
        ids = range(1, len(texts) + 1) if ids is None else ids
        sources = sources or ["s"] * len(texts)
        rows = [(i, t, "en", s, 0, "x", 1.5, "y", 7, True) for i, t, s in zip(ids, texts, sources)]
        clash = ", kept string, score double, _id string, n_tokens int, held_out boolean"
        return spark.createDataFrame(rows, DOCS + clash)

    return build


def answers(df, *columns):
    """Rows by id, as a dictionary of tuples (or single values)."""
    rows = df.select(df.columns[0], *columns).collect()
    return {r[0]: r[1] if len(columns) == 1 else tuple(r[1:]) for r in rows}
