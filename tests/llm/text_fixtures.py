import pytest

WORDS = ("the quick brown fox jumps over a lazy dog while seven wizards quietly mix potions near cold rivers "
         "under bright lanterns and every merchant counts silver coins before dawn breaks across old harbours").split()


def text_of(rng, n):
    """Random words with some variety in length and case."""
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture
def edge_docs(spark):
    """Null id, null and empty texts, repeated rows, one long text, and columns with clashing names."""
    rows = [
        (1, "Hello wide world, this is a text of some words.", "x"), (1, "Hello wide world, this is a text of some words.", "x"),
        (2, None, None), (3, "", "y"), (None, "a null id has a text too", "z"), (4, " \t\n ", "y"),
        (5, "word " * 30_000 + "end", "long"), (6, "naïve café 日本 \U0001F600 ﬁn", "u"), (7, "x" * 5000, "one"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, place string").selectExpr(
        "doc_id", "text", "place", "place AS node", "place AS block", "1 AS n", "place AS key", "'k' AS kept")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
