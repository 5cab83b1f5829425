import pytest

#: Null, empty, blank, one word, few words, ties, repeated rows, a null id, and a very long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "Alpha beta GAMMA"),
    (6, "alpha  beta gamma"),
    (7, "the same text of more than five words stands here twice"),
    (7, "the same text of more than five words stands here twice"),
    (8, "the same text of more than five words stands here twice"),
    (None, "a row without an id has seven words"),
    (9, "lang " * 30_000),
    (10, "ÄÖÜ straße – naïve #$% 12ab"),
]
SCHEMA = "doc_id long, text string, score string, kept string, bucket int, low int, node string, law string, line string"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "n", "l", "z") for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
