import random

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "be", "co", "de", "er", "th", "ing", "mu"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls in every column, empty and very long texts, ties and repeated rows."""
    base = prose(1, 120)
    near = base.split()
    near[7], near[60] = "changed", "words"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(2, 120)), (5, ""), (6, None), (None, prose(3, 50)), (None, None), (7, prose(4, 60)), (7, prose(4, 60)),
        (8, prose(5, 60_000)), (9, "two words"), (10, "two words"), (11, " \n "), (12, "you idiot, " + prose(6, 20)), (13, "Call +1 (212) 555-0187 or write a.b@mail1.example.com"), (14, prose(7, 80)),
    ]
    return spark.createDataFrame([(i, x, None if i == 4 else "en", None, None if x is None else len(x)) for i, x in rows], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(12, 0, 1), (4, 1, 0), (14, 1, None), (None, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(documents):
    """The documents with further columns named as the operators name their own."""
    from pyspark.sql import functions as F

    own = "found toxicity __text_hash digest sig root key nid shard tokens a b place host templates original copies".split()
    return documents.select("*", *[F.lit("x").alias(c) for c in own])


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


__all__ = ["T", "prose", "rows_of"]
