import pytest

SF = "/root/testdata/sf0.001"

#: Nulls, empty and long texts, ties, repeated rows, clashing column names.
ODD = [
    (0, "The same  words\nhere for all of them to see", 1, "a"),
    (1, "The same words here for all of them to see", 1, "b"),
    (2, None, 2, None),
    (3, "", 2, "c"),
    (4, " \t\n", None, "d"),
    (5, "a b", 3, "e"),
    (5, "a b", 3, "e"),
    (6, "long " * 30_000 + "end", 4, "f"),
    (None, "The same words here for all of them to see", 5, "g"),
    (None, "nobody's words", 5, "h"),
    (7, "naïve ﬁ ▁ x  y   z <s> <|endoftext|> 🙂 ́a", 6, "i"),
    (8, "x " * 4096, 6, "j"),
    (9, " lead and trail ", 6, "k"),
    (10, "\x1c \x85  ", 6, "l"),
]
ODD_SCHEMA = "doc_id long, text string, id int, length string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
