"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), over Arrow batches.

Words are lower-cased; words of fewer than three characters stay so.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix pairs of steps 2, 3 and the suffixes of step 4, as published.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_VC = re.compile("V+C+")


def _form(w: str) -> str:
    """Each letter as V or C; y is a vowel behind a consonant."""
    out = ""
    for i, c in enumerate(w):
        out += "V" if c in "aeiou" or c == "y" and i and out[-1] == "C" else "C"
    return out


def measure(w: str) -> int:
    return len(_VC.findall(_form(w)))


def _has_vowel(w: str) -> bool:
    return "V" in _form(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "C"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _form(w)[-3:] == "CVC" and w[-1] not in "wxy"


def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = ""
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        elif measure(cut) == 1 and _cvc(cut):
            w = cut + "e"
        else:
            w = cut
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for old, new in sorted(table, key=lambda p: -len(p[0])):
            if w.endswith(old):
                if measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in sorted(STEP4, key=len, reverse=True):
        if w.endswith(old):
            base = w[: -len(old)]
            if measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def porter(word: Column) -> Column:
    """Stem of a word; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {w: stem(w) for w in s.dropna().unique()}
        return s.map(known)

    return run(word)
