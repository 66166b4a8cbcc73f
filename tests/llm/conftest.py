import pytest

#: texts that every operator on documents must take
LONG = " ".join(f"w{i % 977}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5, 1, "x", 1.0),
        (2, "ALPHA beta gamma delta epsilon zeta", "en", "a", 5, 1, "x", 1.0),
        (2, "ALPHA beta gamma delta epsilon zeta", "en", "a", 5, 1, "x", 1.0),
        (3, "", None, None, None, None, None, None),
        (4, None, "de", "b", 0, 2, "y", None),
        (None, "a null id with some words in it", "en", "b", 3, None, None, 0.5),
        (None, None, None, None, None, None, None, None),
        (5, LONG, "en", "c", 9, 3, "z", 2.0),
        (6, LONG + " tail", "en", "c", 9, 3, "z", 2.0),
        (7, " \t\n ", "fr", "é", 4, 4, "q", 3.0),
        (8, "Ünïcode ÄÖ 東京   x", "fr", "é", 4, 4, "q", 3.0),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "row bigint, label string, size double").withColumnRenamed("row", "__row")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))
