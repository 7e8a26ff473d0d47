"""A trained sentence segmenter: candidate boundaries by character category, features, classification.

Candidates and their features come from one pass over each text; a linear classifier over hashed
features is trained on candidates whose gold is known, and texts are cut where it says so.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.operators import learning

_BREAKS = "\r\n\t"
#: A line of fewer characters is short: its end may end a sentence without a mark.
SHORT_LINE = 35
_WORD = re.compile(r"\w+")
LABELS = ["in", "end"]


def _contraction(text: str, i: int, quote: str) -> bool:
    """Does this quote stand between two letters or digits?"""
    return text[i] == quote and 0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum()


def is_candidate(text: str, i: int) -> bool:
    """Could a sentence end with this character?"""
    c = text[i]
    if c in _BREAKS:
        if i and text[i - 1] == ",":
            return False
        after = text[i + 1] if i + 1 < len(text) else ""
        return i == 0 or not after or after in _BREAKS or i - text.rfind("\n", 0, i) < SHORT_LINE or after.isupper()
    kind = unicodedata.category(c)
    if kind == "Po":
        return c != "," and not _contraction(text, i, "'")
    if kind == "Pf":
        return not _contraction(text, i, "’")
    if kind in ("Pi", "Ps", "Pe"):
        return True
    if kind == "Zs" and i:
        b = text[i - 1]
        return not b.isalnum() and not b.isspace() and b != "," and not is_candidate(text, i - 1)
    return False


def candidates(text: str) -> list[int]:
    """Places of the characters that could end a sentence; the text's last one is always there."""
    found = [i for i in range(len(text)) if not text[i].isalnum() and is_candidate(text, i)]
    return found if not text or found and found[-1] == len(text) - 1 else [*found, len(text) - 1]


def features(text: str, i: int) -> list[str]:
    """What is seen at a candidate: characters and their kinds around it, alone and together, the word
    before and its length, the next letter, and whether the line is short."""
    at = lambda k: text[i + k] if 0 <= i + k < len(text) else ""
    kind = lambda c: unicodedata.category(c) if c else "##"
    out = [f"k{k}={kind(at(k))}" for k in range(-2, 3)] + [f"c{k}={at(k) or '###'}" for k in range(-2, 3)]
    out += [f"kk{k}={kind(at(k))}{kind(at(k + 1))}" for k in range(-2, 2)] + [f"kkk{k}={kind(at(k))}{kind(at(k + 1))}{kind(at(k + 2))}" for k in range(-2, 1)]
    j = i
    while j > 0 and not text[j - 1].isalnum() and i - j < 3:
        j -= 1
    k = j
    while k > 0 and text[k - 1].isalnum():
        k -= 1
    word = text[k:j]
    n = i + 1
    while n < len(text) and text[n].isspace():
        n += 1
    m = _WORD.search(text, i + 1)
    after = m[0] if m else ""
    out += [f"w={word.lower()}", f"wl={min(len(word), 6)}", f"n={after.lower()}", f"nk={kind(after[:1])}", f"around={at(-1)}|{text[n : n + 1]}", f"kinds={kind(at(-1))}|{kind(text[n : n + 1])}"]
    out += [f"wn={word.lower()}|{kind(text[n : n + 1])}", f"short={i - text.rfind(chr(10), 0, i) < SHORT_LINE}", f"c0kinds={at(0)}|{kind(at(-1))}|{kind(text[n : n + 1])}"]
    return out


def snap(text: str, ends: list[int]) -> set[int]:
    """Candidates that gold ends (exclusive offsets) belong to: the last one at or before the end's last
    character that is no space, if no letter lies between, else the first one behind it."""
    c = np.array(candidates(text), dtype=np.int64)
    out = set()
    for e in ends:
        last = e - 1
        while last > 0 and text[last].isspace():
            last -= 1
        p = int(np.searchsorted(c, last, side="right")) - 1
        if p >= 0 and not any(x.isalnum() for x in text[c[p] + 1 : last + 1]):
            out.add(int(c[p]))
        elif p + 1 < len(c):
            out.add(int(c[p + 1]))
    return out


def rows(df: DataFrame, id_col: str, text_col: str, ends_col: str | None = None) -> DataFrame:
    """(id, at, features ARRAY<INT>, label): the candidates of texts, with their gold where the ends
    (ARRAY<INT>, exclusive) are given."""
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(ends_col) if ends_col else F.lit(None).cast("array<int>")).alias("ends")).where("text <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, text, ends in zip(b["id"], b["text"], b["ends"]):
                c = candidates(text)
                gold = snap(text, list(ends)) if ends is not None else set()
                yield pd.DataFrame({"id": i, "at": c, "f": [features(text, x) for x in c], "label": [LABELS[x in gold] for x in c]})

    r = src.mapInPandas(run, f"id {kind}, at int, f array<string>, label string")
    return r.select("id", "at", learning.hash_features(F.col("f")).alias("features"), "label")


def fit(labelled: DataFrame, passes: int = 12) -> np.ndarray:
    return learning.fit(labelled, LABELS, "log", passes)


def split(df: DataFrame, weights: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, begin, end): sentences of texts; blank ones are left out, the text's end always ends one."""
    kind = df.schema[id_col].dataType.simpleString()
    ends = learning.predict(rows(df, id_col, text_col), weights, LABELS, ["id", "at"]).where("pred = 'end'")
    by = ends.groupBy("id").agg(F.array_sort(F.collect_list("at")).alias("cuts"))
    t = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''").join(by, "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, cuts in zip(b["id"], b["text"], b["cuts"]):
                last = 0
                for c in [*([] if cuts is None else cuts), len(text) - 1]:
                    if c + 1 > last and text[last : c + 1].strip():
                        out.append((i, last, int(c) + 1))
                    last = max(last, int(c) + 1)
            yield pd.DataFrame(out, columns=["id", "begin", "end"])

    return t.mapInPandas(run, f"id {kind}, begin int, end int").withColumnRenamed("id", id_col)
