"""English stems by the published Porter2 algorithm, for tokens that should meet across their endings."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import code_tokens

# Fixed values of the algorithm: irregular words, words left alone after the first step, doubles, endings.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
DONE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(rf"{_V}{_C}")


def _regions(word: str) -> tuple[int, int]:
    m = re.match("(?:gener|commun|arsen)", word)
    r1 = m.end() if m else (m.end() if (m := _REGION.search(word)) else len(word))
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search(rf"{_C}{_V}[^aeiouywxY]$", word) or re.fullmatch(rf"{_V}{_C}", word))


@lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.lower().removeprefix("'")
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub("(?<=[aeiouy])y", "Y", re.sub("^y", "Y", word))
    r1, r2 = _regions(word)
    word = re.sub("'(?:s'?)?$", "", word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_V, word[:-2]):
        word = word[:-1]
    if word in DONE:
        return word
    # 1b
    if word.endswith(("eedly", "eed")):
        end = 5 if word.endswith("eedly") else 3
        if len(word) - end >= r1:
            word = word[: len(word) - end] + "ee"
    elif m := re.search("(?:ingly|edly|ing|ed)$", word):
        if re.search(_V, word[: m.start()]):
            word = word[: m.start()]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif _short(word) and r1 >= len(word):
                word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # 2
    for end, new in STEP2.items():
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + new
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in tuple("cdeghkmnrt"):
            word = word[:-2]
    # 3
    for end, new in STEP3.items():
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: len(word) - len(end)] + new
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    # 4
    for end in STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2:
                word = word[: -len(end)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    # 5
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short(word[:-1])):
        word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def stemmed_tokens(text: Column) -> Column:
    """``code_tokens`` with the stems that aren't among them, of more than one letter."""
    plain = code_tokens(text)
    return F.array_distinct(F.concat(plain, F.filter(stems(plain), lambda t: F.length(t) > 1)))
