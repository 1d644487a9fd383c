import pytest

#: Columns that the operators use inside; a table may have them as well.
EXTRA = ["key", "n", "part", "local", "sig", "comp", "token", "_carry", "rank", "length"]


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text[, lang, source]) with extra columns of clashing names."""

    def make(rows):
        rows = [(*r, *(("en", "s")[len(r) - 2 :])) for r in rows]
        df = spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(EXTRA)) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in EXTRA)]))
        return df

    return make
