import pytest

SCHEMA = "doc_id long, text string, lang string, id long, row string, a int, spans string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, extra columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog near the quiet river bank while seven small birds sing in the old tree"
    long = " ".join(f"word{i} goes on" for i in range(40_000))
    rows = [
        (1, base, "en", 9, "x", 1, "s"), (2, base, "en", 9, "x", 1, "s"), (3, base + " today", "en", None, None, None, None),
        (4, None, None, None, None, None, None), (5, "", "de", 1, "", 0, ""), (6, " \t\n ", "de", 1, "", 0, ""), (7, long, "de", 1, "y", 2, "t"),
        (8, "ein kleiner Satz über das Wetter mit ö und ß", "de", 1, "y", 2, "t"), (8, "ein kleiner Satz über das Wetter mit ö und ß", "de", 1, "y", 2, "t"),
        (None, "a row without an id", "en", 1, "y", 2, "t"), (10, "mail me at joe@example.com or +1 555 123 4567 or 10.0.0.1", "en", 1, "y", 2, "t"),
        (11, "\U0001f600 é ▁ \u0000 <s> 12", None, 1, "y", 2, "t"), (12, "12 34", "en", 1, "y", 2, "t"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the small test table's documents, for brute force."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
