import pytest
from pyspark.sql import functions as F

from ordermart.session import ship_package

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text) rows, with other columns of names that operators use."""

    def frame(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for name in ("n_bytes", "hash", "key", "node", "score", "spans", "own_id", "own_hash",
                     "start", "length", "words", "range", "bands", "__x", "predicted", "kept"):
            df = df.withColumn(name, F.lit("other"))
        return df

    return frame


#: Null id, null and empty and blank texts, repeated rows, repeated id, a long text.
AWKWARD = [
    (None, "some words without any id at all"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "the same row twice is two documents of the same words"),
    (5, "the same row twice is two documents of the same words"),
    (5, "another text under the same id"),
    (6, LONG),
    (7, "naïve café 漢字 😀 \x00 \x1c <|endoftext|> it's\r\n"),
]
