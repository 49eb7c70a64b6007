"""Small pandas UDFs: English word stems and the full compatibility fold.

Both run on distinct values only; callers join the result back.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

_MEASURE = re.compile(r"V+C+")


def _shape(word: str) -> str:
    """Vowel/consonant pattern; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "C")
        out.append("V" if vowel else "C")
    return "".join(out)


def _measure(word: str) -> int:
    return len(_MEASURE.findall(_shape(word)))


def _ends_cvc(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "CVC" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "C"


# Suffix tables of the published Porter algorithm (1980), longest match first.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
          "iti", "ous", "ive", "ize")


def _swap(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) >= least else word
    return word


def stem_word(word: str) -> str:
    """Porter stem of a lower-case word; short and non-ASCII words stay."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "V" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _ends_cvc(word):
                word += "e"
    if word.endswith("y") and "V" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, _STEP2, 1)
    word = _swap(word, _STEP3, 1)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 16)
def kept_stem(word: str) -> str:
    """``stem_word``, kept by a Python worker for the words that follow."""
    return stem_word(word)


@F.pandas_udf(T.StringType())
def porter_stem(tokens: pd.Series) -> pd.Series:
    return tokens.map(stem_word, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkd_fold(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    def fold(text: str) -> str:
        return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    return texts.map(fold, na_action="ignore")


def with_stem(df: DataFrame, token: str = "term", out: str = "stem") -> DataFrame:
    """Add the stem of ``token``: the UDF sees each distinct token once."""
    stems = df.select(F.col(token)).distinct().withColumn(out, porter_stem(F.col(token)))
    return df.join(stems, token)
