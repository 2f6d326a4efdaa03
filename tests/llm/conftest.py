import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LONG = " ".join(f"word{i % 977} thing{i % 13}" for i in range(12_000))
NOTE = "one two three four five six seven eight nine ten"
#: Nulls in every column, empty and very long texts, repeated rows and repeated ids.
ODD = [
    (1, NOTE), (2, NOTE), (2, NOTE), (3, NOTE.replace(" ", "\t\n ")), (4, None), (5, ""), (6, " \n "), (7, LONG), (8, LONG + " end"), (None, NOTE), (None, None),
    (9, "short"), (10, "short"), (11, "Straße ÉCOLE ünïcode é́  x 日本語 \U0001f600 <|endoftext|>"), (12, "a"), (12, "b c d e f g"), (13, NOTE + " eleven"), (14, "x " * 5000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with columns whose names operators use themselves."""
    rows = [(*r, i, "key", 1.0, "d") for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, key string, score double, digest string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
