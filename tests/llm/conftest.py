import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves, and a column that differs from ``text`` in capitals only.
EXTRA = "TEXT string, n_words bigint, component_id bigint, _range int, digest string, removed string, rate double, score double"


@pytest.fixture(scope="session")
def docs(spark):
    """``docs([(doc_id, text), ...])``; more fields of a row are lang, source and n_chars."""

    def make(rows):
        full = [(i, t, *more, *("en", "s", len(t or ""))[len(more) :]) for i, t, *more in rows]
        return spark.createDataFrame(full, DOCS)

    return make


LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(20_000))
ODD_ROWS = [
    (None, "a text without an id that is as long as any other of these texts are", "en", "s", None),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", None, 4),
    (4, LONG, "de", "s", len(LONG)),
    (5, LONG, "de", "s", len(LONG)),
    (6, "short", "en", "s", 5),
    (6, "short", "en", "s", 5),
    (7, "naïve ▁ café 😀 <|endoftext|> \u0000 \x1c x", "fr", "t", 30),
    (8, "x" * 5000, "en", "s", 5000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long and repeated texts, beside columns whose names clash."""
    extra = ("other text", 1, 2, 3, "d", "r", 0.5, 0.5)
    return spark.createDataFrame([r + extra for r in ODD_ROWS], f"{DOCS}, {EXTRA}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The documents of the smallest test table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
