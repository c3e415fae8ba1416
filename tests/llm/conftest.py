import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def table(spark):
    """A documents table from (doc_id, text) or whole rows."""

    def make(rows, extra=""):
        full = [r if len(r) > 2 else (*r, "en", "src0", None) for r in rows]
        return spark.createDataFrame(
            full, f"doc_id long, text string, lang string, source string, n_chars long{extra}"
        )

    return make


#: Nulls, empty and white texts, ties, repeated rows and a very long text.
ODD = [
    (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "one  two"),
    (6, "One two"), (7, "é ñ 日本 \U0001f600 x"), (8, "word " * 40_000), (9, "a" * 60_000),
    (10, "line one.\nline one.\n|||\n"), (11, "x\x1cy z"), (12, "one two\n"),
]


@pytest.fixture
def odd(table):
    return table(ODD)


CLASHING = (
    "digest string, hash string, maybe string, row string, kept string, keep_id string, best_id string, "
    "fp string, key string, u string, v string, kept_id string, least string, tokens string, "
    "topic string, weight string, probability string, cell_source string, score string, toxic string"
)


@pytest.fixture
def clashing(table):
    names = [part.split()[0] for part in CLASHING.split(", ")]
    rows = [(*r, "en", "src0", 1, *names) for r in ODD]
    return table(rows, ", " + CLASHING)
