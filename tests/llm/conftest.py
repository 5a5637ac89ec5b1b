import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def prose():
    """prose(n): n words of an invented language, repeatable."""
    rng = random.Random(5)
    syllables = ["an", "er", "in", "on", "th", "es", "re", "ti", "ou", "he", "st", "en", "ha", "nt", "ed"]

    def make(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        """rows: (doc_id, text[, source])"""
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)

    return make
