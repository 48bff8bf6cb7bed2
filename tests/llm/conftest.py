import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, k bigint, node string, key string, keep boolean, _n int, n int, h string"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empties, a very long text, repeats and clashing extra columns."""
    prose = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
    texts = [
        (1, prose, "en", "a"),
        (1, prose, "en", "a"),
        (2, prose + " again", "en", "a"),
        (3, "", "en", "b"),
        (4, None, None, None),
        (None, "no id here but words", "en", "b"),
        (5, " ".join(f"w{i % 977}" for i in range(40_000)), "de", "b"),
        (6, "x" * 50_000, "de", None),
        (7, " \n\t ", "fr", "c"),
        (8, "one", "fr", "c"),
        (9, "It's <|endoftext|> ÀÉ ΣΑΣ 日本 12345 !!!", "fr", "c"),
    ]
    rows = [(*t, len(t[1] or ""), 7, "n", "k", False, 3, 1, "h") for t in texts]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
