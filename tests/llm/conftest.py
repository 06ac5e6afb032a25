"""Small tables with the odd rows that every operator must stand."""

import random

import pytest

WORDS = "the of and river stone green walk under cloud paper window seven gentle harbour copper signal meadow lantern orbit".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randrange(40))]) for _ in range(n))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture
def documents(spark):
    """Null and empty cells, repeated rows, equal ids, long texts, and columns named like those of the operators."""
    long = prose(1, 6000)
    rows = [
        (1, prose(2, 40), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "fr", "b", 3),
        (None, prose(3, 30), "en", "b", 5), (None, None, None, "a", None), (5, long, "en", "a", 9), (5, long, "en", "a", 9),
        (6, prose(2, 40), "en", "c", 1), (7, "one", "de", "c", 3), (7, "two words", "de", "c", 3), (8, long + " more", "en", "b", 4),
        (9, "ÄÖ ß naïve   日本語 👍 İ", "de", "b", 2), (10, "line\nline\nline\n\n" * 30, "en", "a", 2),
    ]
    names = ["kept", "score", "spans", "n_words", "_key", "similarity", "labels"]
    df = spark.createDataFrame([(*r, *(["x"] * len(names))) for r in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    return df


@pytest.fixture
def no_documents(documents):
    return documents.limit(0)
