import pytest

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, label string, _copies int"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))
    texts = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", None), (4, long, "en", "b"), (5, "one two", "en", "b"), (6, "One  two", "fr", "b"),
        (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "c"), (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "c"),
        (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", None), (None, "été à la plage — naïve 日本語 ﬁ ½", "fr", "c"), (10, "12345 !!!", "en", "c"),
        (11, "x" * 5000, "de", "d"), (12, "Licensed under the Apache License, Version 2.0.\nAll rights reserved. CC BY", None, "d"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 7, 7, "z", 3) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DDL)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DDL)
