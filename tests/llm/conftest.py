import pytest

#: null, empty and blank texts, ties, repeated rows, one long text; extra columns have names that operators use.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (2, "The quick  brown fox\njumps over the lazy dog", "en", "b"),
    (3, None, None, None), (4, "", "de", "a"), (5, " \t\n", "fr", None), (6, "ein zwei drei", "de", "c"), (6, "ein zwei drei", "de", "c"),
    (None, "no id here", "en", "a"), (7, "wort " * 5000, "de", "a"), (8, "naïve café – 🙂 １２３", "fr", "b"), (9, "x", "en", "a"), (10, "the quick brown fox jumps over the lazy cat", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, digest string, id string, shard string, rank int, _cell int, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame([(*r, None, "s", "d", "i", "h", 1, 2, "k") for r in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)
