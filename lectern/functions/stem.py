"""Porter stemming and diacritics folding of tokens, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of the published algorithm's steps and what they become.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
)


def _shape(stem: str) -> str:
    """The stem as runs of C and V; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(stem):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "C")
        out += "V" if vowel else "C"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("V+C+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "CVC" and stem[-1] not in "wxy"


def _longest(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-case ASCII word; other words and short ones stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    tidy = False
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "V" in _shape(word[:-2]):
        word, tidy = word[:-2], True
    elif word.endswith("ing") and "V" in _shape(word[:-3]):
        word, tidy = word[:-3], True
    if tidy:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "C" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"
    if word.endswith("y") and "V" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(_longest(word, STEP2), STEP3)
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def folded(word: str) -> str:
    """Without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def stems(words: Column) -> Column:
    """The stems of an array of tokens."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda own: None if own is None else [porter(folded(w)) for w in own])

    return run(words)


def nfkc_fold(text: Column) -> Column:
    """NFKC and case folding, which SQL does not have."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return run(text)
