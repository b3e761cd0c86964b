import pytest

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(80))


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [
        (1, "Some text that is  here", "s1"), (2, "Some text\tthat is here", "s1"), (3, None, None), (4, "", "s2"), (5, "   \n ", "s2"), (6, LONG, "s2"),
        (7, LONG + " end", "s3"), (8, f"start {PASSAGE} finish", "s3"), (9, f"other {PASSAGE} thing", None), (9, f"other {PASSAGE} thing", None),
        (None, "no id at all", "s1"), (10, "ünïcode Ärger ẞ", "s1"), (11, "word", "s1"), (12, "word", "s1"),
    ]
    return spark.createDataFrame([(*r, "x", 0, "t", 1.5) for r in rows], "doc_id long, text string, source string, id string, n int, block string, score double")


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return spark.createDataFrame([], edge_docs.schema)
