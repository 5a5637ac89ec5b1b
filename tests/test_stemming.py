"""The stemmer against an independent chain of patterns, and words without case and accents."""

import random

import duckdb
import pytest

from codexmill import queries as own
from codexmill.functions import stemming

KNOWN = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "sensibiliti": "sensibl", "electrical": "electr", "adoption": "adopt", "homologous": "homolog", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "generalizations": "gener", "by": "by", "a": "a", "s" * 70: "s" * 70}


@pytest.mark.parametrize("word", KNOWN)
def test_known_stems(word):
    assert stemming.stem(word) == KNOWN[word]


def test_stems_match_the_patterns():
    rng = random.Random(12)
    parts = ["at", "bl", "iz", "y", "e", "ss", "l", "ll", "ing", "ed", "eed", "ies", "s", "ion", "t", "a", "rr", "o", "x", "é", "9", *stemming.STEP2, *stemming.STEP3, *stemming.STEP4]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(6000)})
    c = duckdb.connect()
    c.execute("create table words(word varchar)")
    c.executemany("insert into words values (?)", [(w,) for w in words[:2500]])
    got = dict(c.execute(f"WITH {own._porter_sql('SELECT word FROM words')} SELECT word, stem FROM st").fetchall())
    assert got == {w: stemming.stem(w) for w in words[:2500]}


def test_words_without_case_and_accents():
    assert stemming.words("Éléphants_über 3 cafés, ÅNGSTRÖM! ß 日本") == ["elephants", "uber", "3", "cafes", "angstrom", "ß", "日本"]
    assert stemming.stems("Running runners RAN") == ["run", "runner", "ran"]
    assert stemming.words(None) == stemming.words("") == []
