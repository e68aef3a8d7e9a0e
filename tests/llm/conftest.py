import pytest

LONG = " ".join(f"w{i % 997}" for i in range(6000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns whose names results have."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, "  \t\n ", "fr", "b"),
        (5, LONG, "en", "hot"),
        (6, LONG + " tail", "en", "hot"),
        (7, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (7, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (8, "x" * 3000 + " éÀÜ 漢字 😀 don't I'LL   two  spaces \r\n <|endoftext|>", "de", "b"),
        (9, "start " + PASSAGE + " end", "en", "a"),
        (10, "other words " + PASSAGE + " and more", "en", "a"),
        (None, "other words " + PASSAGE + " and more", "en", "a"),
        (None, None, "en", "a"),
        (11, "one", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 AS score", "'k' AS kept", "2 AS items", "3 AS bits", "4 AS ids", "5 AS n_words", "6 AS row", "cast(length(text) AS long) AS n_chars", "7 AS component_id", "8 AS block")


@pytest.fixture(scope="session")
def empty(hard):
    return hard.where("false")
