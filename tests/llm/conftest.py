import pytest
from compare import duck

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Nulls, empty and long texts, ties, repeated rows.
ODD = [
    (1, None), (2, ""), (3, "  \n "), (4, "One two three four five six."), (4, "One two three four five six."),
    (5, "One two three four five six."), (None, "no id here"), (6, "word " * 30000), (7, "é̀ ▁ \U0001f600\t中文 \x00 end"),
    (8, "a" * 20000), (-9, "negative id"),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def con():
    return duck("/root/testdata/sf0.001")
