import random

import pytest

TEXT = "doc_id long, text string"


@pytest.fixture(scope="session")
def corpus():
    """Small texts with copies, near copies, repeats, odd white space, nulls and empties."""
    rng = random.Random(11)
    words = ["alpha", "beta", "Gamma,", "delta.", "é", "漢字", "x", "the", "of", "and", "idiot", "zeta!"]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(words) + (str(rng.randint(0, 40)) if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 90)))))
    rows += [(100, rows[5][1]), (101, rows[5][1] + " tail"), (102, None), (103, ""), (104, " \t\n "), (105, "a  b\tc\n\nd e\n"), (106, "line one of a text\nline one of a text\nother"), (None, "no key at all, but words enough to count for the base test of quality here")]
    rows += [(107, "same row"), (107, "same row"), (108, "word " * 400)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with the operators' own."""
    rows = [(k, t, "k", 1, "r") for k, t in corpus]
    return spark.createDataFrame(rows, TEXT + ", key string, fp int, words string").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], TEXT)
