import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "ids string, hits int, score string, block int, key string, fp int, root string, shard int, listed int")
EXTRA = ("own", 7, "own", 7, "own", 7, "own", 7, 7)

PROSE = ("the river runs past the old mill and the children of the village play there in the long evenings "
         "while their parents talk about the harvest and the price of bread ")


def rows():
    long_text = " ".join(f"{PROSE}{i}" for i in range(1500))
    texts = [
        (1, PROSE * 3, "en"), (2, "", "en"), (3, None, "en"), (4, "   \n\t ", None),
        (5, PROSE * 3, "en"), (5, PROSE * 3, "en"), (None, PROSE * 3, "en"), (None, None, None),
        (6, long_text, "en"), (7, "x" * 30_000, "de"), (8, "naïve café 中文 😀 <|endoftext|> don't", "fr"),
        (9, "l0ser tra$h ıdiot", "en"), (10, "one", None), (11, "one two", "en"),
    ]
    return [(i, t, lang, "src0", None if t is None else len(t), *EXTRA) for i, t, lang in texts]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (5, 1, 0), (5, 0, 0), (6, 1, 0), (7, 0, None), (9, 1, 1), (None, 1, 1), (10, None, 0), (99, 1, 1)],
        "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
