"""Porter stems of words, for retrieval that should not depend on endings or accents.

The rules are those of the published algorithm (1980): steps of suffix tables whose conditions count the vowel-consonant
sequences of what would remain."""

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes and what replaces them, longest first where one ends another.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(stem: str) -> str:
    """Vowels and consonants of a stem as letters v and c; y is a vowel behind a consonant."""
    out = ""
    for k, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x and y."""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def replaced(word: str, table: dict[str, str]) -> str:
    """The word with its longest listed suffix replaced, if something is left to measure."""
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if measure(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif (m := re.fullmatch("(.*)(ed|ing)", word)) and "v" in shape(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and short_end(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not short_end(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def words(text: str | None) -> list[str]:
    """Stems of a text's words, accents removed."""
    flat = unicodedata.normalize("NFKD", text or "")
    return [stem(w) for w in re.findall(r"[^\W_]+", "".join(c for c in flat if not unicodedata.combining(c)).lower())]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([words(t) for t in texts], dtype=object)


def stems(text: Column) -> Column:
    return _stems(text)
