import pytest

DATA = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, label int, path string, digest string, keep boolean, TEXT string, shard int"


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in any column, empty and blank and very long texts, repeated rows and ids, and columns with clashing names."""
    long = "the quick word of many words " * 20_000
    rows = [(1, "plain words of a short text here", "en"), (1, "plain words of a short text here", "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "en"), (5, long, "en"), (6, "!!! ??? ...", "fr"), (None, "a row without any id at all", "en"), (7, "é ▁ \x00 😀 日本語", None), (8, "plain words of a short text here", "de")]
    return spark.createDataFrame([(i, t, g, None, None, 7, "p", "d", None, "upper", 1) for i, t, g in rows], EXTRA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{DATA}/pages.parquet")
