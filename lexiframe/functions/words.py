"""Word functions: shape, class, affixes, properties, normal forms. All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of the class signature, in the order they are tried.
CLASS_SUFFIXES = ("ed", "ing", "ion", "er", "est", "ly", "ity", "y", "al")
# The transliteration of Arabic letters, mark by mark.
BUCKWALTER = "'|>&<}AbptvjHxd*rzs$SDTZEg_fqklmnhwYyFNKaui~o`{PJVG"
ARABIC = "ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىيًٌٍَُِّْٰٱپچڤگ"
# Escaped brackets of treebanks.
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def shape(w: Column) -> Column:
    """X for upper case, x for other letters, d for digits; a run of three or more becomes two and e."""
    s = F.regexp_replace(w, r"\p{Lu}", "X")
    s = F.regexp_replace(s, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]", "x")
    s = F.regexp_replace(s, r"\p{Nd}", "d")
    for c in "Xxd":
        s = F.regexp_replace(s, c + "{3,}", c * 2 + "e")
    return s


def word_class(w: Column) -> Column:
    """Signature of an English word: case, digits, dash, and one inflectional suffix."""
    caps = F.length(F.regexp_replace(w, r"[^\p{Lu}\p{Lt}]", ""))
    first_cap = w.rlike(r"^[\p{Lu}\p{Lt}]")
    first_letter = w.rlike(r"^\p{L}")
    digit, dash = w.rlike(r"\p{Nd}"), F.contains(w, F.lit("-"))
    other = F.length(w) > caps
    low = F.lower(w)
    case = (
        F.when(first_cap & (caps == 1), "-INITC")
        .when(first_cap, "-CAPS")
        .when(~first_letter & (caps > 0), "-CAPS")
        .when(other, "-LC")
        .otherwise("")
    )
    tail = F.when(low.endswith("s") & (F.length(low) >= 3), F.when(~low.rlike(r"[siu]s$"), "-s").otherwise(""))
    suffix = None
    for s in CLASS_SUFFIXES:
        cond = low.endswith(s)
        suffix = F.when(cond, f"-{s}") if suffix is None else suffix.when(cond, f"-{s}")
    fits = (F.length(low) >= 5) & ~dash & ~(digit & (caps > 0))
    tail = tail.otherwise(F.when(fits, suffix.otherwise("")).otherwise(""))
    return F.concat(case, F.when(digit, "-NUM").otherwise(""), F.when(dash, "-DASH").otherwise(""), tail)


def digits_to_zero(w: Column) -> Column:
    return F.regexp_replace(w, r"\p{Nd}", "0")


def prefixes(w: Column, order: int = 7) -> Column:
    """Prefixes of 1 to min(length - 1, order) characters of words of four or more."""
    n = F.least(F.length(w) - 1, F.lit(order))
    return F.when(F.length(w) >= 4, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(w, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def suffixes(w: Column, order: int = 7) -> Column:
    """Suffixes of 1 to min(length - 1, order) characters of words of five or more."""
    n = F.least(F.length(w) - 1, F.lit(order))
    return F.when(F.length(w) >= 5, F.transform(F.sequence(F.lit(1), n), lambda i: F.right(w, i))).otherwise(F.array().cast("array<string>"))


def properties(w: Column) -> Column:
    """Sorted names of the word's properties."""
    caps = F.length(F.regexp_replace(w, r"[^\p{Lu}]", ""))
    lower, letter, digit = w.rlike(r"\p{Ll}"), w.rlike(r"\p{L}"), w.rlike(r"\p{Nd}")
    all_caps = (caps >= 2) & ~lower & ~w.rlike(r"[^\p{L}]")
    acronym = all_caps & F.length(w).between(3, 5) | (F.contains(w, F.lit(".")) & ~lower & (caps >= 1) & ~digit & ~w.rlike(r"[^\p{L}.]") & (F.length(w) >= 2))
    init = w.rlike(r"^\p{Lu}")
    year = F.coalesce(w.rlike(r"^[0-9]{4}$") & F.regexp_extract(w, r"^([0-9]{4})$", 1).try_cast("int").between(1400, 2299), F.lit(False))
    named = {
        "AllCaps": all_caps,
        "Dash": F.contains(w, F.lit("-")),
        "Digit": digit,
        "EndsWithPeriod": w.endswith("."),
        "EndsWithS": w.endswith("s"),
        "Float": w.rlike(r"^[0-9]*\.[0-9]+$"),
        "HasCap": caps > 0,
        "InitCap": init,
        "InitCapS": init & w.endswith("s"),
        "Initial": w.rlike(r"^\p{Lu}\.$"),
        "Integer": w.rlike(r"^[0-9]+$"),
        "Long": F.length(w) > 10,
        "ManyCap": caps > 1,
        "NoLetter": ~letter,
        "NoLower": ~lower,
        "NotLetter": w.rlike(r"[^\p{L}]"),
        "ProbablyAcronym": acronym,
        "ProbablyYear": year,
        "Short": F.length(w) < 5,
    }
    return F.filter(F.array(*[F.when(c, k) for k, c in named.items()]), lambda x: x.isNotNull())


def buckwalter_to_arabic(s: Column) -> Column:
    """Arabic letters of a transliterated word; escaped brackets pass through."""
    return F.when(s.isin(*BRACKETS), s).otherwise(F.translate(s, BUCKWALTER, ARABIC))


def unescape_bracket(w: Column) -> Column:
    out = None
    for k, v in BRACKETS.items():
        out = F.when(w == k, v) if out is None else out.when(w == k, v)
    return out.otherwise(w)


def escape_bracket(w: Column) -> Column:
    out = None
    for k, v in BRACKETS.items():
        out = F.when(w == v, k) if out is None else out.when(w == v, k)
    return out.otherwise(w)


def vector_key(w: Column, lowercase: bool = False) -> Column:
    """The form under which a word is looked up in a vector table: brackets unescaped, long numbers
    as one word, of a hyphenated word the last part."""
    x = unescape_bracket(w)
    x = F.when(x.rlike(r"^[0-9]{5,}$"), "fifteen").otherwise(x)
    x = F.when(x.rlike(r"^.+-[^-]+$"), F.regexp_extract(w, r"^(.+)-([^-]+)$", 2)).otherwise(x)
    return F.lower(x) if lowercase else x


def label_parts(label: Column) -> Column:
    """STRUCT<base, index, functions> of a treebank label: cut at - = #, digits are an index."""
    parts = F.filter(F.split(F.when(label == "PRT|ADVP", "PRT").otherwise(label), "[-=#]"), lambda x: x != "")
    base = F.when(label.startswith("-"), label).otherwise(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("TOP")))
    rest = F.when(label.startswith("-"), F.array().cast("array<string>")).otherwise(F.coalesce(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array().cast("array<string>")))
    number = F.filter(rest, lambda x: x.rlike("^[0-9]+$"))
    return F.struct(
        base.alias("base"),
        F.coalesce(F.try_element_at(number, F.lit(-1)).cast("int"), F.lit(-1)).alias("idx"),
        F.filter(rest, lambda x: ~x.rlike("^[0-9]+$")).alias("functions"),
    )
