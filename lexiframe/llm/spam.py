"""Keyword-stuffed and link-list pages (problem 10).

A text is cut into units (lines; long ones at sentence ends, and what has none into windows of a
fixed number of words, which together cover the whole text). All units of an Arrow batch are
measured at once over word codes: words, function words, words and word pairs that the document
repeats, the most repeated word, repeated lines, links, separators and prices.

What is usual is calibrated per language over all documents: the share of function words, of
repeated words, of repeated word pairs and of the top word; the thresholds follow from it. Languages
that the lists below don't know get their function words from the collection itself: words that
stand in a quarter of the documents with that label. Where a text is in no known language, nothing
is concluded from missing function words.

A unit is spam when it is a link without a sentence around it, a repeated line without function
words, a run of separated labels, a price line, one word over and over, or a run of repeated words
or word pairs that misses the language's function words. A document is spam when more than half of
its words stand in such units.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.session import cut

# Common function words of each language.
FUNCTION_WORDS = {
    "en": "a an the of in on at by for from to with and or nor but as is are was were be been it its this that these those he she they we you i his her our their my not no who what when where why which will would can could has have had do does did than then so if after before between into over about all every some neither still while although said there here them us him me how just near under",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht in im an am auf aus bei mit nach von vom zu zum zur um ohne für durch gegen seit trotz über unter vor zwischen ist sind war wird werden hat haben ich du er sie es wir ihr als wie wenn dass sich auch noch nur so man wer was wo frau herr",
    "fr": "le la les l un une des du de d et ou mais ne pas en au aux à dans sur sous avec sans pour par depuis malgré après avant dès est sont été a ont il elle ils elles on nous vous je tu ce cette ces son sa ses leur leurs qui que qu où se s y plus puis comme si quand entre chez",
    "es": "el la los las un una unos unas de del y e o u pero no en a al con sin para por desde hace hasta sobre entre tras después antes que qué quien dónde cuando como si es son fue ha han se su sus lo le les yo tú él ella nosotros ellos este esta ese esa pesar muy más ya luego",
    "hi": "का की के को ने से में पर और या नहीं है हैं था थी थे यह वह ये वे इस उस एक तक क्या जो तो भी ही कि बाद पास साथ लिए बारिश अंक",
    "ar": "في من على إلى عن مع هذا هذه ذلك التي الذي و أو لا لم لن ما هل قد كان كانت أن إن بعد قبل منذ قرب رغم كل بين عند د",
}
# Frequent particles and function words of scripts without spaces.
PARTICLES = {
    "zh": "的 了 在 是 和 也 着 过 不 与 之 就 都 很 还 被 把 我 你 他 她",
    "ja": "の は を に が で と た も し て い る な か",
    "th": "และ ใน ที่ ของ เป็น ใกล้ หลัง การ ให้ ได้ ไม่ จะ ว่า กับ แก่ จาก เมื่อ ท่าม",
}
# Letters of each of these languages beside a to z.
LETTERS = {"en": "", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü"}

#: Words of a window, and characters of one in scripts without spaces; windows cover the whole text.
UNIT, UNSPACED_UNIT = 30, 60
#: A word is repeated when it makes up this share of a document's words and stands there so often.
REPEATED_SHARE, REPEATED_TIMES = 0.02, 4
#: A pair of words is repeated when it stands in the document so often.
PAIR_TIMES = 3
#: Share of the usual function words below which a unit misses them.
MISSING = 0.35
#: A unit without function words that stands in a document so often is a repeated line.
SAME_TIMES = 3
#: Usual share at least, where a language has too few texts (or only spam) to tell it.
LEAST_USUAL = 0.05
#: Least thresholds on a unit's shares: repeated words, repeated pairs, top word (pair of characters in
#: scripts without spaces). Where a language's usual share is high, the threshold is CALIBRATION times as far
#: from none as that; for pairs, which even plain prose repeats, so much nearer to all.
RUN_SHARE, PAIR_SHARE, TOP_SHARE, TOP_PAIR_SHARE, TOP_TIMES = 0.34, 0.6, 0.2, 0.15, 3
CALIBRATION = 3.0
#: Languages without a list: words in this share of so many documents are taken as function words.
LEARNED_SHARE, LEARNED_DOCS = 0.25, 20
#: A text whose language is in doubt and that has less than this part of the usual share is in none known.
DOUBT = 0.5
#: Share of words with letters foreign to a language above which it is in doubt.
FOREIGN = 0.1
#: Characters that are measured together; longer texts are measured alone.
TOGETHER = 1_000_000

#: Words that a worker keeps codes of before it begins anew.
BOOK = 200_000

_M = [c for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M"]
_MARKS = "".join(chr(c) for c in _M)
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_URL = re.compile(r"https?://\S+|\bwww\.\S+|<a\s[^>]*>|</a>|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}/\S*", re.I)
_HASHTAG = re.compile(r"#[^\W\d_]\w{3,}")
_WORD = re.compile(rf"[^\W\d_][\w'’{_MARKS}]*")
_WORD_ASCII = re.compile(r"[A-Za-z][A-Za-z0-9_']*")
_SEP = re.compile(r"[|»›•·;,/]")
_BAR = re.compile(r"\s[|»›•·]\s|^[|»›•·]\s")
_PRICE = re.compile(r"[$€£¥₹]\s?\d|\d\s?[€£¥₹]")
_SENTENCE_END = re.compile(r"(?<=[.!?।؟…])[\"'”’»)]*\s+(?=[^\sa-zà-öø-ÿ])")
_MIXED = re.compile(r"[a-z][0-9]|[0-9][a-z]")
_CODE = re.compile(r"[a-z]\d+")
# Fixed value: digits that stand in for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})
_NO_SPACES = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_SCRIPT = {"th": re.compile("[\u0e00-\u0e7f]"), "ja": re.compile("[\u3040-\u30ff]"), "zh": re.compile("[\u3400-\u9fff]")}
_UNSPACED_RUN = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]+")
_PARTICLE = {k: re.compile("|".join(sorted(v.split(), key=len, reverse=True))) for k, v in PARTICLES.items()}
_UNSPACED_END = re.compile(r"(?<=[。！？!?])")
_LABEL = re.compile(r"[a-z]{2,3}")

#: What is measured of a unit; labels is -1 in units of scripts without spaces.
COLUMNS = ("tokens", "words", "function", "repeated", "top", "links", "tags", "bars", "prices", "labels", "same", "pairs")


def clean(text: str) -> str:
    return _HIDDEN.sub("", unicodedata.normalize("NFKC", text)) if not text.isascii() else text


def word_form(w: str) -> str:
    low = w.lower()
    return low.translate(_LEET) if _MIXED.search(low) and not _CODE.fullmatch(low) else low


def units(text: str) -> list[str]:
    """Lines; long ones cut at sentence ends, and what is still long into windows of UNIT words."""
    out = []
    for line in text.splitlines():
        if not (line := line.strip()):
            continue
        for p in _SENTENCE_END.split(line) if line.count(" ") >= UNIT - 10 else [line]:
            if p.count(" ") < UNIT + 10:
                if p and not p.isspace():
                    out.append(p)
                continue
            words = p.split()
            if len(words) <= UNIT + 10:
                out.append(p)
            else:
                out += [" ".join(words[i : i + UNIT]) for i in range(0, len(words), UNIT)]
    return out


def unspaced_units(text: str) -> list[str]:
    out = []
    for line in text.splitlines():
        for p in _UNSPACED_END.split(line):
            if p.strip():
                out += [p[i : i + UNSPACED_UNIT] for i in range(0, len(p), UNSPACED_UNIT)]
    return out


def script_language(text: str) -> str | None:
    """zh, ja or th where a third of the text is in a script without spaces."""
    if text.isascii() or len(_NO_SPACES.findall(text)) * 3 <= len(text):
        return None
    return "th" if _SCRIPT["th"].search(text) else "ja" if len(_SCRIPT["ja"].findall(text)) * 10 > len(text) else "zh"


def _writing(c: str) -> str:
    """Which writing a letter belongs to, as its name begins."""
    return unicodedata.name(c, "?").split()[0]


class Profiles:
    """Function words, letters and writing of each language with spaces."""

    def __init__(self, learned: dict[str, list[str]] | None = None):
        self.words = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()} | {k: frozenset(v) for k, v in (learned or {}).items()}
        self.names = sorted(self.words)
        # None: every letter of the language's writing belongs to it
        self.letters = {k: frozenset("abcdefghijklmnopqrstuvwxyz" + LETTERS[k]) if k in LETTERS else None for k in self.words}
        self.writing = {k: Counter(_writing(w[0]) for w in v if w).most_common(1)[0][0] if v else "?" for k, v in self.words.items()}


class _Book(dict):
    """Codes of surface words; what is known of a word is worked out once."""

    def __init__(self, profiles: Profiles):
        super().__init__()
        self.profiles = profiles
        self.forms: dict[str, int] = {}
        self.form, self.upper = [], []  # per surface word
        self.hits, self.foreign, self.writing = [], [], []  # per form: bits of the languages

    def __missing__(self, w: str) -> int:
        form = word_form(w)
        f = self.forms.get(form)
        if f is None:
            f = self.forms[form] = len(self.forms)
            names = self.profiles.names
            self.hits.append(sum(1 << i for i, k in enumerate(names) if form in self.profiles.words[k]))
            letters, here = {c for c in form if c.isalpha()}, _writing(form[0])
            own = self.profiles.letters
            self.foreign.append(sum(1 << i for i, k in enumerate(names) if (here != self.profiles.writing[k] if own[k] is None else not letters <= own[k])))
            self.writing.append(sum(1 << i for i, k in enumerate(names) if self.profiles.writing[k] == here))
        self[w] = code = len(self.form)
        self.form.append(f)
        self.upper.append(w.isupper() and len(w) <= 5)
        return code


def _bits(of: list[int], forms: np.ndarray, n: int) -> np.ndarray:
    """(words, n): the bits of each word's form."""
    if n < 63:
        flags = (np.array(of, dtype=np.int64)[:, None] >> np.arange(n)) & 1
    else:
        flags = np.array([[x >> i & 1 for i in range(n)] for x in of])
    return flags.astype(bool).reshape(-1, n)[forms]


def measure(texts: list[str | None], said: list[str | None], profiles: Profiles, book: _Book | None = None) -> tuple[list[str], list[bool], np.ndarray, np.ndarray]:
    """(language, is it in doubt) of each text and (text, counts in the order of COLUMNS) of each unit.
    A book may be handed on from call to call; what it holds of words doesn't depend on the texts."""
    book = _Book(profiles) if book is None else book
    n_docs = len(texts)
    lang: list[str] = ["none"] * n_docs
    unspaced = np.zeros(n_docs, dtype=bool)
    unit_doc: list[int] = []
    plain: list[list[int]] = []
    sizes: list[int] = []
    codes: list[int] = []
    look = book.__getitem__
    for d, text in enumerate(texts):
        if not text or text.isspace():
            continue
        text = clean(text)
        script = script_language(text)
        lang[d] = script or "spaced"
        unspaced[d] = bool(script)
        word = _WORD_ASCII if text.isascii() else _WORD
        linked, tagged = "/" in text or "www." in text or "WWW." in text or "<" in text, "#" in text
        barred = any(c in text for c in "|»›•·")
        priced = any(c in text for c in "$€£¥₹")
        for p in unspaced_units(text) if script else units(text):
            links = tags = 0
            rest = p
            if linked and ("/" in p or "." in p or "<" in p):
                rest, links = _URL.subn(" ", rest)
            if tagged and "#" in p:
                rest = _HASHTAG.sub(" ", rest)
                tags = len(_HASHTAG.findall(p))
            if script:
                ws = [r[i : i + 2] for r in _UNSPACED_RUN.findall(p) for i in range(len(r) - 1)]
                function, tokens = len(_PARTICLE[script].findall(p)), len("".join(p.split()))
            else:
                ws = word.findall(rest)
                function, tokens = 0, len(p.split())
            codes.extend(map(look, ws))
            sizes.append(len(ws))
            unit_doc.append(d)
            plain.append([tokens, function, links, tags, len(_BAR.findall(p)) if barred else 0, len(_PRICE.findall(p)) if priced else 0])
    doc = np.array(unit_doc, dtype=np.int64)
    n_units = len(doc)
    if not n_units:
        return lang, [False] * n_docs, doc, np.zeros((0, len(COLUMNS)), dtype=np.int32)
    own = np.array(plain, dtype=np.int64)
    size = np.array(sizes, dtype=np.int64)
    code = np.array(codes, dtype=np.int64)
    forms = np.array(book.form, dtype=np.int64)[code] if len(code) else code
    unit = np.repeat(np.arange(n_units), size)
    of_doc = doc[unit]
    v = max(1, len(book.forms))
    n_words = np.bincount(of_doc, minlength=n_docs)

    # language by most function words of the text's writing
    names = profiles.names
    hit, other, writing = (_bits(x, forms, len(names)) for x in (book.hits, book.foreign, book.writing))
    per = lambda flags: np.stack([np.bincount(of_doc, flags[:, i], n_docs) for i in range(len(names))], axis=1)
    hits, strange, fits = per(hit), per(other), per(writing)
    doubt = [False] * n_docs
    which = np.zeros(n_docs, dtype=np.int64)
    for d in range(n_docs):
        if lang[d] != "spaced":
            continue
        label = (said[d] or "").strip().lower()
        base = label[:2] if label[:2] in profiles.words else label.split("-")[0]
        able = fits[d] * 2 > n_words[d]
        n = max(1, n_words[d])
        if not able.any():
            lang[d], doubt[d] = (base if base in profiles.words else "en" if "en" in profiles.words else names[0]), n_words[d] > 0
            which[d] = names.index(lang[d])
            continue
        best = int(np.where(able, hits[d], -1.0).argmax())
        if hits[d][best] * 12 >= n and hits[d][best] > 0:
            which[d] = best
        else:
            which[d] = names.index(base if base in profiles.words and able[names.index(base)] else "en" if able[names.index("en")] else names[int(able.argmax())])
        i = int(which[d])
        elsewhere = bool(_LABEL.fullmatch(base)) and base not in ("und", "none", "nan", "zxx", "mul") and base not in profiles.words and base not in PARTICLES
        doubt[d] = elsewhere or bool(strange[d][i] > FOREIGN * n)
        lang[d] = names[i]

    if len(code):
        is_function = hit[np.arange(len(code)), which[of_doc]] & ~unspaced[of_doc]
        upper = np.array(book.upper, dtype=np.float64)[code]
        _, inv, cnt = np.unique(of_doc * v + forms, return_inverse=True, return_counts=True)
        total = cnt[inv]
        all_upper = np.bincount(inv, upper)[inv] == total
        free = (~is_function & ~all_upper) | unspaced[of_doc]
        often = free & (total >= REPEATED_TIMES) & (total >= REPEATED_SHARE * n_words[of_doc])
        count = lambda flags: np.bincount(unit, flags, n_units).astype(np.int64)
        function, repeated, labels = count(is_function), count(often), count(all_upper)
        top = np.zeros(n_units, dtype=np.int64)
        at = np.flatnonzero(free)
        if len(at):
            key, times = np.unique(unit[at] * v + forms[at], return_counts=True)
            np.maximum.at(top, key // v, times)
        # words that stand in a repeated pair
        nxt = np.flatnonzero(unit[:-1] == unit[1:])
        covered = np.zeros(len(code), dtype=bool)
        if len(nxt):
            _, pair = np.unique(forms[nxt] * v + forms[nxt + 1], return_inverse=True)
            _, inv, cnt = np.unique(of_doc[nxt] * (pair.max() + 1) + pair, return_inverse=True, return_counts=True)
            again = nxt[cnt[inv] >= PAIR_TIMES]
            covered[again] = covered[again + 1] = True
        pairs = count(covered)
    else:
        function = repeated = labels = top = pairs = np.zeros(n_units, dtype=np.int64)
    lines: Counter = Counter()
    starts = np.r_[0, np.cumsum(size)]
    key_of = [(d, forms[a:b].tobytes()) for d, a, b in zip(unit_doc, starts[:-1].tolist(), starts[1:].tolist())]
    lines.update(key_of)
    same = np.array([lines[k] for k in key_of])
    is_unspaced = unspaced[doc]
    function = np.where(is_unspaced, own[:, 1], function)
    labels = np.where(is_unspaced, -1, labels)
    rows = np.stack([own[:, 0], size, function, repeated, top, own[:, 2], own[:, 3], own[:, 4], own[:, 5], labels, same, pairs], axis=1)
    return lang, doubt, doc, rows.astype(np.int32)


#: Per language: usual shares of function words, repeated words, repeated pairs and the top word.
Usual = tuple[float, float, float, float]


def verdict(rows: np.ndarray, doc: np.ndarray, usual: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """For each unit: is it spam? doc: the document of each unit, in order; usual (units, 4): what is
    usual in its language; unknown: is the text in no known language?"""
    c = {name: rows[:, i].astype(np.float64) for i, name in enumerate(COLUMNS)}
    words = np.maximum(c["words"], 1)
    share = c["function"] / words
    normal = np.maximum(usual[:, 0], LEAST_USUAL)
    run_share, pair_share = np.maximum(RUN_SHARE, CALIBRATION * usual[:, 1]), np.maximum(PAIR_SHARE, 1 - (1 - usual[:, 2]) / CALIBRATION)
    unspaced = c["labels"] < 0
    top_share = np.maximum(np.where(unspaced, TOP_PAIR_SHARE, TOP_SHARE), CALIBRATION * usual[:, 3])
    below = lambda part: unknown | (share < part * normal)
    lacks = ~unknown & (share < MISSING * normal)
    named = c["labels"] >= 0.3 * words
    link = (c["links"] > 0) & below(0.5) & (c["words"] <= 8 * c["links"])
    tags = (c["tags"] >= 2) & (c["tags"] * 2 >= c["tokens"])
    bars = (c["bars"] >= np.where(unknown, 3, 1)) & (c["words"] <= 7 * (c["bars"] + 1)) & (lacks | unknown)
    price = (c["prices"] > 0) & (c["words"] <= 12 * c["prices"]) & below(0.6)
    topped = (c["top"] >= TOP_TIMES) & (c["top"] >= top_share * words) & (c["repeated"] >= run_share * words)
    run = lacks & (c["words"] >= 6) & (c["repeated"] >= run_share * words) & ~named
    grams = lacks & (c["words"] >= 6) & (c["pairs"] >= pair_share * words) & (c["repeated"] >= 0.5 * run_share * words) & ~named
    again = (c["same"] >= SAME_TIMES) & lacks & (c["words"] >= 4) & ~named
    spam = link | tags | again | np.where(unspaced, topped & lacks, bars | price | topped | run | grams)
    # a short unit between two spam units of its document goes with them
    if len(spam) > 2:
        between = np.zeros(len(spam), dtype=bool)
        inside = (doc[:-2] == doc[1:-1]) & (doc[1:-1] == doc[2:])
        between[1:-1] = inside & spam[:-2] & spam[2:] & (c["words"][1:-1] <= 8)
        spam |= between
    return spam


def learn(df: DataFrame) -> dict[str, list[str]]:
    """Function words of languages (lang, text) without a list: those in LEARNED_SHARE of all
    documents of the label, where there are LEARNED_DOCS of them. As every document holds boundedly
    many such words on average, the answer is small."""
    known = [*FUNCTION_WORDS, *PARTICLES, "und", "mul", "zxx", ""]
    label = F.split(F.lower(F.trim("lang")), "[-_]")[0]
    t = df.select(label.alias("lang"), "text").where(F.col("lang").isNotNull() & ~F.col("lang").isin(*known) & F.col("text").isNotNull())
    w = t.select("lang", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("ws")).where(F.size("ws") >= 20)
    n = w.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= LEARNED_DOCS)
    per = w.join(F.broadcast(n), "lang").select("lang", "n_docs", F.explode("ws").alias("w")).groupBy("lang", "n_docs", "w").agg(F.count(F.lit(1)).alias("n"))
    out: dict[str, list[str]] = {}
    for r in per.where(F.col("n") >= LEARNED_SHARE * F.col("n_docs")).select("lang", "w").collect():
        out.setdefault(r["lang"], []).append(r["w"])
    return out


def _together(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of TOGETHER characters at most, or of one longer text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i > start and held + size > TOGETHER:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_tokens, n_spam): words of each document and those of them in spam units.

    Null, empty and blank texts have no words. Null and wrong languages are found from the text.
    Other columns are not read.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kind = src.schema["doc_id"].dataType.simpleString()
    learned = learn(src)
    width = len(COLUMNS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles(learned)
        book = _Book(profiles)
        for b in batches:
            texts, said = b["text"].tolist(), b["lang"].tolist()
            for i, j in _together(texts):
                if len(book.form) > BOOK:
                    book = _Book(profiles)
                lang, doubt, doc, rows = measure(texts[i:j], said[i:j], profiles, book)
                starts = np.searchsorted(doc, np.arange(j - i + 1))
                flat = [rows[a:z].ravel() for a, z in zip(starts[:-1], starts[1:])]
                sums = np.zeros((j - i, 5), dtype=np.int64)
                for k, name in enumerate(("words", "function", "repeated", "pairs", "top")):
                    sums[:, k] = np.bincount(doc, np.maximum(rows[:, COLUMNS.index(name)] - (name == "top"), 0), j - i)  # a top word that stands once says nothing
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[i:j], "lang": lang, "doubt": doubt, "units": flat, "w": sums[:, 0], "f": sums[:, 1], "r": sums[:, 2], "p": sums[:, 3], "t": sums[:, 4]})

    counted = cut(src.mapInPandas(count, f"doc_id {kind}, lang string, doubt boolean, units array<int>, w bigint, f bigint, r bigint, p bigint, t bigint"))
    # per language, over all documents: the median shares; a row per language
    middle = lambda c: F.percentile_approx(F.col(c) / F.col("w"), 0.5, 1000).alias(c)
    said = counted.where("w >= 8 and not doubt").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *map(middle, "frpt")).collect()
    # too few texts tell what share of function words to expect, but not how much repetition
    usual = {r["lang"]: (r["f"], r["r"], r["p"], r["t"]) if r["n"] >= LEARNED_DOCS else (r["f"], 0.0, 0.0, 0.0) for r in said}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = np.array([len(u) // width for u in b["units"]], dtype=np.int64)
            n_tokens, n_spam = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            if sizes.sum():
                rows = np.concatenate([np.asarray(u) for u in b["units"]]).reshape(-1, width)
                doc = np.repeat(np.arange(len(b)), sizes)
                normal = np.array([usual.get(x, (0.0, 0.0, 0.0, 0.0)) for x in b["lang"]])
                share = b["f"].to_numpy() / np.maximum(b["w"].to_numpy(), 1)
                unknown = b["doubt"].to_numpy() & (share < DOUBT * np.maximum(normal[:, 0], LEAST_USUAL))
                spam = verdict(rows, doc, normal[doc], unknown[doc])
                n_tokens = np.bincount(doc, rows[:, 0], len(b)).astype(np.int64)
                n_spam = np.bincount(doc, rows[:, 0] * spam, len(b)).astype(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n_tokens, "n_spam": n_spam})

    return counted.select("doc_id", "lang", "doubt", "units", "w", "f").mapInPandas(judge, f"doc_id {kind}, n_tokens bigint, n_spam bigint")


def found(df: DataFrame, over: float = 0.5) -> DataFrame:
    """(doc_id) of documents with more than half of their words in spam units."""
    return scores(df).where(F.col("n_spam") > F.lit(over) * F.col("n_tokens")).select("doc_id").distinct()
