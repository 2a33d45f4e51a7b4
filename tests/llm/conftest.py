import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, found int, slot int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names clash with outputs."""

    def of(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 0.5, 1, 2) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return of


# Nulls everywhere, empty and long texts, ties and repeated rows.
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(make):
    return make([(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, LONG, None), (5, "x" * 5000), (6, " \n\t "), (7, "A B C D E F", None)])


@pytest.fixture(scope="session")
def none(make):
    return make([])
