import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """docs_of([(id, text), ...]): a documents table."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words from a small lexicon."""

    def make(seed, n):
        r = random.Random(seed)
        syllables = ["the", "ing", "tion", "an", "er", "ou", "st", "ble", "é"]
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ".", ","]) for _ in range(n))

    return make
