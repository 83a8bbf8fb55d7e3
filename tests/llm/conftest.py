import pytest

TEXTS = [
    (1, "Released under the MIT License. mit, license", "en", "b"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n", "en", "a"),
    (5, "one two three four five six seven", "en", "a"),
    (5, "one two three four five six seven", "en", "a"),
    (6, "one two three four five six seven", "de", None),
    (None, "ONE two three four five six seven", None, "c"),
    (7, "GNU General   Public-License; general public", "en", "b"),
    (8, "word " * 30000 + "apache license x@y.example.com", "en", "b"),
    (9, "é" * 3000, "fr", ""),
    (10, "Licensed under the Apache License, Version 2.0. \u2581 \U0001F600 \x00 end", "en", "c"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns that clash with added names."""
    rows = [(*r, None if r[1] is None else len(r[1]), 7, "x", 1.5) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "shard int, fp string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def pairs(df, *cols):
    key = lambda t: tuple((x is None, str(x)) for x in t)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


SF = "/root/testdata/sf0.001"
