import random

import pytest
from pyspark.sql import types as T

# Extra columns have names that the operators use themselves.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        *(T.StructField(n, T.StringType()) for n in ("id", "bands", "component", "bucket", "score", "spans", "kept", "n_words", "__row", "toxic")),
    ]
)
VOCABULARY = [f"w{k}" for k in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        return spark.createDataFrame([(i, t, *["x"] * 10) for i, t in rows], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def odd_rows():
    """Null and equal ids, null, empty and blank texts, repeated rows, ties and a very long text."""
    long = prose(1, 60_000)
    return [
        (1, prose(2, 80)), (2, None), (3, ""), (4, " \n\t"), (5, prose(2, 80)), (6, long), (7, long + " tail"),
        (7, long + " tail"), (None, prose(3, 70)), (8, "one two"), (9, "ONE two"), (10, "é" * 3000), (11, "one\x0btwo three"),
    ]
