import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{DATA}/pages.parquet").cache()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash."""
    long_text = " ".join(f"word{k % 977} other{k % 13}" for k in range(30_000))
    rows = [
        (1, None, "en", "a", "x", 1),
        (2, "", None, None, None, None),
        (3, " \t\n ", "en", "a", "x", 1),
        (4, "one", "en", "b", "x", 1),
        (5, "one", "en", "b", "x", 1),
        (5, "one", "en", "b", "x", 1),
        (None, "two words", "fr", None, "x", 1),
        (None, None, None, None, None, None),
        (6, long_text, "en", "a", "x", 1),
        (7, long_text + " end", "en", "a", "x", 1),
        (8, "▁ mark \U0001f600 \x00 é é   ﷐ token=abcdef1234", "en", "a", "x", 1),
        (9, "12 34 !!", "en", "a", "x", 1),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, score string, size int"
    )


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("doc_id = -1")
