"""Names and codes: entity and mention types, punctuation, characters, morphology bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiframe.sources.delimited import NER_TYPES

# Mention types by how they are written.
MENTION_TYPES = {
    "ident": "IDENT", "identity": "IDENT", "head": "APPOS_HEAD", "appos head": "APPOS_HEAD", "apposhead": "APPOS_HEAD",
    "attrib": "APPOS_ATTRIB", "appos attrib": "APPOS_ATTRIB", "apposattrib": "APPOS_ATTRIB",
}


def ner_type(name: Column) -> Column:
    """The entity type of a name in any case, WORKOFART read as WORK_OF_ART; null for others."""
    up = F.upper(F.trim(name))
    up = F.when(up == "WORKOFART", "WORK_OF_ART").otherwise(up)
    return F.when(up.isin(*NER_TYPES), up)


def mention_type(name: Column) -> Column:
    out = None
    for k, v in MENTION_TYPES.items():
        out = F.when(F.lower(F.trim(name)) == k, v) if out is None else out.when(F.lower(F.trim(name)) == k, v)
    return out


def is_punctuation(w: Column) -> Column:
    """Are all characters punctuation, by their Unicode category?"""
    return w.rlike(r"^\p{P}+$")


def morph_bits(bits: Column) -> Column:
    """MAP of `name=value` parts parted by |; parts without = have the value true, `_` is empty."""
    parts = F.filter(F.split(bits, r"\|"), lambda x: (x != "") & (x != "_"))
    entry = lambda x: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_extract(x, "=(.*)$", 1)).otherwise("true").alias("v"))
    # of a name that comes twice the first counts
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(parts, lambda x: entry(x)["k"])), lambda k: F.struct(k, F.get(F.filter(F.transform(parts, entry), lambda e: e["k"] == k), 0)["v"])))


def char_name(c: str) -> str:
    """A printable name of a character: control and white-space ones by their code."""
    import unicodedata

    return unicodedata.name(c, f"U+{ord(c):04X}")
