"""Words of a lexical index: letters and digits without case or accents, reduced to stems by
Porter's algorithm (with its author's later changes to `abli` and `logi`)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# The endings of the algorithm's second, third and fourth step.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ]+")


def folded(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text))


def words(text: str | None) -> list[str]:
    return _WORD.findall(folded(text)) if text else []


def _shape(word: str) -> str:
    """c or v for each letter; y after a consonant is a vowel."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How many times consonants follow vowels."""
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(word))))


def _short(word: str) -> bool:
    """Whether a word ends in consonant, vowel, consonant, the last none of w, x, y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _endings(endings) -> re.Pattern:
    """Finds the longest of some endings that a word has."""
    return re.compile("(?:" + "|".join(endings) + ")$")


_PAST, _SECOND, _THIRD, _FOURTH = _endings(("ed", "ing")), _endings(STEP2), _endings(STEP3), _endings(STEP4)


@lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    """Words of less than three bytes or more than 64 stay as they are."""
    if len(word) < 3 or len(word.encode()) > 64:
        return word
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (end := _PAST.search(word)) and "v" in _shape(word[: end.start()]):
        word = word[: end.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for pattern, to in ((_SECOND, STEP2), (_THIRD, STEP3)):
        if (end := pattern.search(word)) and _measure(word[: end.start()]):
            word = word[: end.start()] + to[end[0]]
    if (end := _FOURTH.search(word)) and _measure(word[: end.start()]) > 1 and (end[0] != "ion" or word[: end.start()].endswith(("s", "t"))):
        word = word[: end.start()]
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or (m == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stems(text: str | None) -> list[str]:
    return [stem(w) for w in words(text)]
