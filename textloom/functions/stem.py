"""English stems by the published Porter2 rules. Spark has none, so words go through Arrow batches, each distinct word once."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_FIXED = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEPT_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    m = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters and those that aren't plain stay."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    word = word.removeprefix("'")
    if word in _FIXED:
        return _FIXED[word]
    if word in _KEPT:
        return word
    word = re.sub(f"(^|(?<=[{_VOWELS}]))y", "Y", word)
    if word.startswith(("gener", "arsen")):
        r1 = 5
    elif word.startswith("commun"):
        r1 = 6
    else:
        r1 = _region(word, 0)
    r2 = _region(word, r1)
    # possessives and plurals
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWELS}]", word[:-2]):
        word = word[:-1]
    if word in _KEPT_LATER:
        return word
    # past forms and participles
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(end):
            if end.startswith("eed"):
                if len(word) - len(end) >= r1:
                    word = word[: -len(end)] + "ee"
            elif re.search(f"[{_VOWELS}]", word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(_DOUBLES):
                    word = word[:-1]
                elif r1 >= len(word) and _short_end(word):
                    word += "e"
            break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    for end, by in _STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1 and not (end == "ogi" and not word.endswith("logi")) and not (end == "li" and word[-3:-2] not in tuple("cdeghkmnrt")):
                word = word[: -len(end)] + by
            break
    for end, by in _STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: -len(end)] + by
            break
    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2 and not (end == "ion" and word[-4:-3] not in ("s", "t")):
                word = word[: -len(end)]
            break
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def stemmed(tokens: Column) -> Column:
    """The stems of a list of words, in order; null lists stay null."""

    @F.pandas_udf("array<string>")
    def each(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [None if w is None else stem(w) for w in x])

    return each(tokens)


def phrase_stemmed(text: Column) -> Column:
    """A phrase with each of its words stemmed and its punctuation gone."""
    return F.array_join(stemmed(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))), " ")
