import pytest

LONG = " ".join(f"word{i % 977}x" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; (doc_id, text, lang, source, n_chars)."""
    plain = "the quick brown fox jumps over the lazy dog while nobody is looking at it"
    return [
        (1, plain, "en", "b", 73),
        (2, plain.upper(), "en", "b", 73),
        (3, None, "en", "a", None),
        (4, "", None, "a", 0),
        (5, LONG, "en", None, len(LONG)),
        (6, "  \n\t ", "en", "", 5),
        (7, "naïve café ŒUVRE 日本語 <|endoftext|> token=abcdef123456", "fr", "c", 40),
        (8, plain, "en", "c", 73),
        (8, plain, "en", "c", 73),
        (9, "one", "en", "b", 3),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with more columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, SCHEMA)
    clash = ("id", "size", "key", "n", "tie", "copy", "line", "cls", "_row", "_id", "_text", "place", "body", "digest", "my col", "a.b", "x-y", "é")
    return docs.select("*", *[F.lit("mine").alias(c) for c in clash])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
