import os
import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty, wordless, long and repeated texts, and a column whose name operators use."""
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "the", "of", "and", "é", "x1", "it's", "42", "!"]
    long = " ".join(r.choices(words, k=30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 1, "x"),
        (1, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 1, "x"),
        (2, None, "en", None, None, None),
        (3, "", None, "b", 0, "y"),
        (4, " \t\n ", "fr", "b", 4, "z"),
        (None, "le petit chat est sur la table et il ne bouge pas du tout", "fr", None, None, None),
        (5, "1234 5678 !!! ???", None, "c", 3, "w"),
        (6, long, "en", "c", len(long), "w"),
        (7, "x" * 50_000, "en", "c", 50_000, "w"),
        (8, "the Quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
