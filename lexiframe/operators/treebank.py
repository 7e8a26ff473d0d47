"""Treebank-style tokenization of English sentences: one ordered set of patterns, longest match first.

Quotes come out in their treebank forms (escape() does the brackets), contractions are split, and an
abbreviation keeps its full stop. A sentence that ends with an abbreviation gets a full stop of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.session import spread

# Abbreviations that keep their stop.
ABBREVIATIONS = (
    "Mr Mrs Ms Dr Prof Gen Gov Sen Rep Rev Hon Capt Col Lt Maj Sgt St Mt Ft Jr Sr Inc Corp Co Ltd Bros Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec "
    "No Nos Fig Figs Vol pp vs etc Approx approx esp incl ca al ed eds dept est"
).split()
# Words that are split in two, with the place of the cut.
SPLITS = {"cannot": 3, "lemme": 3, "gonna": 3, "gimme": 3, "wanna": 3, "gotta": 3}
# Treebank forms of brackets.
FORMS = {"(": "-LRB-", ")": "-RRB-", "[": "-LSB-", "]": "-RSB-", "{": "-LCB-", "}": "-RCB-"}

_CLITIC = r"(?:['’](?:s|S|d|D|m|M|ll|LL|re|RE|ve|VE|[eE][mM]))"
# French words that hang on the one before or behind, Polish endings that hang on a past form.
_FRENCH = r"-t-elles?|-t-ils?|-t-on|-ce|-elles?|-ils?|-je|-la|-les?|-leur|-lui|-mêmes?|-moi|-nous|-on|-toi|-tu|-vous|-en|-y|-ci|-là"
_FRENCH_FIRST = r"[dcjlmnstDCJLNMST]|[Qq]u|[Jj]usqu|[Ll]orsqu"
_POLISH_ENDING = r"m|ś|śmy|ście"
PATTERN = regex.compile(
    rf"""
    (?P<url>(?:https?|ftp|file)://(?:\[[0-9A-Fa-f:.]+\])?[^\s<>"]*[^\s<>".,;:!?)'’”\]])
  | (?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)
  | (?P<handle>[@\#]\w+)
  | (?P<face>[:;=8][-o*']?[)(\[\]DPp/](?!\w)|[<>]?[;:=][-o']?[DdPp()/3>oO]+(?!\w)|(?<![\p{{L}}\d])[<>]?[BX8][-o']?[()/3>]+(?!\w)|</?3+|ಠ_ಠ)
  | (?P<address>(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?![\d.]*\d)|\[(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}\])
  | (?P<dots>…|\.(?:\ ?\.)+)
  | (?P<time>\d{{1,2}}\s?:\s?\d\d(?!\d))
  | (?P<abbr>(?:{'|'.join(ABBREVIATIONS)})\.(?=\s|$|,))
  | (?P<acronym>(?:\p{{L}}\.){{2,}})
  | (?P<degree>Ph\.D\.?|[A-Z]\.(?=\s+\p{{Lu}}))
  | (?P<number>[-+]?(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:[.:/]\d+)*(?:st|nd|rd|th)?(?![\p{{L}}\d]))
  | (?P<host>[\p{{L}}\d]+(?:[-_.][\p{{L}}\d]+)*\.(?:com|org|net|edu|gov|txt|html|example)\b)
  | (?P<polish>[\p{{L}}\d]{{2,}}?[lł][aeoiy]?(?=by(?:{_POLISH_ENDING})?(?![\p{{L}}\d])|(?:śmy|ście)(?![\p{{L}}\d]))|[\p{{L}}\d]{{2,}}?ł[aeoiy]?(?=[mś](?![\p{{L}}\d])))
  | (?P<would>(?<=[lł][aeoiy]?)by(?=(?:{_POLISH_ENDING})?(?![\p{{L}}\d])))
  | (?P<ending>(?<=[lł][aeoiy]?(?:by)?)(?:{_POLISH_ENDING})(?![\p{{L}}\d]))
  | (?P<first>(?:{_FRENCH_FIRST})['’](?=[^\p{{L}}\d\s]))
  | (?P<dye>d['’](?=ye\b)|['’][Tt](?=is\b))
  | (?P<french>(?<=[\p{{L}}\d])(?:{_FRENCH})(?![\p{{L}}\d-]))
  | (?P<host_word>[\p{{L}}\p{{M}}\d]+(?=(?:{_FRENCH})(?![\p{{L}}\d-])))
  | (?P<notword>\p{{L}}+(?=n['’]t\b))
  | (?P<not>n['’]t\b)
  | (?P<clitic>{_CLITIC}(?![\p{{L}}]))
  | (?P<word>[\p{{L}}\p{{M}}\d]+(?:[-‐]\n*[\p{{L}}\p{{M}}\d]+)*(?:['’](?!(?:s|S|d|D|m|M|ll|LL|re|RE|ve|VE|[eE][mM])\b)[\p{{L}}]+)*)
  | (?P<dash>--+|—|–)
  | (?P<run>[?!]+)
  | (?P<quote>``|''|["“”„«»]|[‘’'`])
  | (?P<any>\S)
    """,
    regex.X,
)


def tokenize(text: str) -> list[str]:
    """Tokens of one sentence."""
    out: list[str] = []
    open_double = open_single = False
    last = None
    for m in PATTERN.finditer(text):
        kind, t = m.lastgroup, m[0]
        last = m
        if kind == "dots":
            out.append("...")
        elif kind == "time":
            out.append(regex.sub(r"\s", "", t))
        elif kind == "quote":
            if t in "‘’'`" and t not in ("``", "''"):
                before = text[m.start() - 1] if m.start() else " "
                opening = t in "‘`" or t == "'" and not open_single and (before.isspace() or before in "([{\"“")
                open_single = opening
                out.append("`" if opening else "'")
            else:
                before, after = text[m.start() - 1 : m.start()] or " ", text[m.end() : m.end() + 1] or " "
                opening = t in ("``", "“", "„", "«") or t == '"' and not open_double and not after.isspace() and not before.isalnum() and before not in ".,!?"
                open_double = opening
                out.append("``" if opening else "''")
        elif kind == "dash":
            out.append("--")
        elif kind == "word" and t.lower() in SPLITS:
            at = SPLITS[t.lower()]
            out += [t[:at], t[at:]]
        elif kind in ("clitic", "not"):
            out.append(t.replace("’", "'"))
        elif kind == "word":
            out.append(t.replace("\n", ""))  # a line may break behind a word's dash
        else:
            out.append(t)
    if last is not None and last.lastgroup in ("abbr", "acronym", "degree") and last[0].endswith(".") and not text[last.end() :].strip():
        out.append(".")
    return out


def escape(tokens: list[str]) -> list[str]:
    """Plain tokens in treebank forms: brackets by table, double quotes by turns."""
    out, opened = [], False
    for t in tokens:
        if t in FORMS:
            out.append(FORMS[t])
        elif t in ('"', "“", "”"):
            opened = t == "“" or t == '"' and not opened
            out.append("``" if opened else "''")
        else:
            out.append(t)
    return out


def unescape(token: str) -> str:
    return {v: k for k, v in FORMS.items()}.get(token, {"``": '"', "''": '"'}.get(token, token))


def tokens(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ..., i, token) for one row per sentence; null texts have none."""
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [tokenize(t) if t else [] for t in b[text_col]]
            n = [len(p) for p in parts]
            out = {c: b[c].repeat(n).to_numpy() for c in (id_col, *keep)}
            yield pd.DataFrame({**out, "i": [i for k in n for i in range(k)], "token": [t for p in parts for t in p]})

    src = df.select(id_col, *keep, text_col)
    return spread(src, id_col).mapInPandas(run, ", ".join(kinds) + ", i int, token string")
