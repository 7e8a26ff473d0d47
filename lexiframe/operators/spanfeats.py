"""Featurizers of spans, split points and head-dependent pairs, as column expressions.

A featurizer is a function of the sentence's words (ARRAY<STRING>) and of places in it that gives an
ARRAY<STRING>; sums and products of featurizers are again featurizers. All of it stays in one row:
a span joins its sentence once and nothing is shuffled after that. Words beyond the sentence are #.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import words as W
from lexiframe.operators.spans import char_bin, span_shape

Featurizer = Callable[..., Column]


def none() -> Column:
    return F.array().cast("array<string>")


def zero(*_places) -> Column:
    """The featurizer without features."""
    return none()


def at(words: Column, i: Column) -> Column:
    """The word at a place, # beyond the sentence."""
    return F.coalesce(F.get(words, i), F.lit("#"))


def total(*parts: Featurizer) -> Featurizer:
    """All features of all parts."""
    return lambda *p: F.concat(*[f(*p) for f in parts])


def product(a: Featurizer, b: Featurizer) -> Featurizer:
    """Every feature of a with every one of b."""
    return lambda *p: F.flatten(F.transform(a(*p), lambda x: F.transform(b(*p), lambda y: F.concat(x, F.lit("&"), y))))


def kept_product(a: Featurizer, b: Featurizer, left: bool = True, right: bool = True) -> Featurizer:
    """The product, and beside it the features of the sides that are kept."""
    return total(*([a] if left else []), *([b] if right else []), product(a, b))


def marked(place: str, k: int, form: Callable[[Column], Column] = lambda w: w) -> Featurizer:
    """The form of the word k places behind a span's begin (`B`), end (`E`) or split (`S`)."""

    def f(words: Column, begin: Column, end: Column, split: Column | None = None) -> Column:
        base = {"B": begin, "E": end, "S": split}[place]
        return F.array(F.concat(F.lit(f"{place}{k:+d}="), form(at(words, base + k))))

    return f


def length(words: Column, begin: Column, end: Column, *_split) -> Column:
    n = end - begin
    return F.array(F.concat(F.lit("len="), F.when(n <= 5, n.cast("string")).when(n <= 10, "6-10").otherwise("11+")))


def when_unit(f: Featurizer) -> Featurizer:
    """Features of spans of one word only."""
    return lambda w, b, e, *s: F.when(e - b == 1, f(w, b, e, *s)).otherwise(none())


def when_longer(f: Featurizer, than: int = 1) -> Featurizer:
    """Features of spans of more words than that."""
    return lambda w, b, e, *s: F.when(e - b > than, f(w, b, e, *s)).otherwise(none())


def inner_bigrams(words: Column, begin: Column, end: Column, *_split) -> Column:
    """Pairs of neighbours inside of the span."""
    pairs = F.transform(F.sequence(begin, F.greatest(end - 2, begin)), lambda i: F.concat(F.lit("bi="), at(words, i), F.lit(" "), at(words, i + 1)))
    return F.when(end - begin >= 2, pairs).otherwise(none())


def ngrams(order: int) -> Featurizer:
    """Runs of `order` words inside of the span."""

    def f(words: Column, begin: Column, end: Column, *_split) -> Column:
        grams = F.transform(F.sequence(begin, F.greatest(end - order, begin)), lambda i: F.concat(F.lit(f"{order}g="), F.array_join(F.slice(words, i + 1, order), " ")))
        return F.when(end - begin >= order, grams).otherwise(none())

    return f


def split_lengths(words: Column, begin: Column, end: Column, split: Column) -> Column:
    """Lengths of both sides, and which side is longer."""
    left, right = split - begin, end - split
    side = F.when(left == right, "=").when(left < right, "<").otherwise(">")
    return F.array(F.concat(F.lit("left="), F.least(left, F.lit(8)).cast("string")), F.concat(F.lit("right="), F.least(right, F.lit(8)).cast("string")), F.concat(F.lit("sides="), side))


def split_edges(words: Column, begin: Column, end: Column, split: Column) -> Column:
    """Distances of the split to the sentence's edges, binned."""
    bin_ = lambda n: F.when(n <= 2, n.cast("string")).when(n <= 5, "3-5").otherwise("6+")
    return F.array(F.concat(F.lit("from="), bin_(split)), F.concat(F.lit("to="), bin_(F.size(words) - split)))


def split_shape(words: Column, begin: Column, end: Column, split: Column) -> Column:
    """First-character bins of the span's two sides, parted by |, each shortened as spans are."""
    inner = lambda b, e: F.regexp_extract(span_shape(words, b, e), r"(?s)\[(.*)\]", 1)
    return F.array(F.concat(F.lit("shape="), inner(begin, split), F.lit("|"), inner(split, end)))


def full_shape(words: Column, begin: Column, end: Column, *_split) -> Column:
    """Shapes of all words of the span, in full."""
    return F.array(F.concat(F.lit("full="), F.array_join(F.transform(F.slice(words, begin + 1, end - begin), W.shape), " ")))


def from_spans(f: Featurizer) -> Featurizer:
    """A span featurizer at both sides of a split."""
    mark = lambda side, xs: F.transform(xs, lambda x: F.concat(F.lit(side), x))
    return lambda w, b, e, s: F.concat(mark("l:", f(w, b, s)), mark("r:", f(w, s, e)))


def tag_shape(tag_of: Column, words: Column, begin: Column, end: Column) -> Column:
    """Most frequent tags (a MAP from words) over windows of a span's edges and inside."""
    name = lambda i: F.coalesce(F.try_element_at(tag_of, at(words, i)), F.lit("?"))
    joined = lambda prefix, *places: F.concat(F.lit(prefix), F.concat_ws(" ", *[name(i) for i in places]))
    return F.array(
        joined("t1=", begin, end - 1),
        joined("t2=", begin - 1, end),
        joined("t3=", begin - 1, begin),
        joined("t4=", end - 1, end),
        joined("t5=", begin - 1, begin, end - 1, end),
        F.concat(F.lit("t6="), F.array_join(F.transform(F.sequence(begin, F.least(end, begin + 4) - 1), name), " ")),
    )


def splits(spans: DataFrame) -> DataFrame:
    """Spans of two words and more with each of their split points."""
    s = spans.where(F.col("end") - F.col("begin") >= 2)
    return s.withColumn("split", F.explode(F.sequence(F.col("begin") + 1, F.col("end") - 1)))


def with_words(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """Spans (sent_id, begin, end, ...) with the words of their sentence, stripped; null words are empty."""
    clean = F.transform("words", lambda w: F.coalesce(F.trim(w), F.lit("")))
    return spans.join(sentences.select("sent_id", clean.alias("words")), "sent_id")


def features(rows: DataFrame, f: Featurizer, *more: str) -> DataFrame:
    """One row per feature of rows (words, begin, end, and more places)."""
    keep = [c for c in rows.columns if c != "words"]
    return rows.select(*keep, F.explode(f(F.col("words"), F.col("begin"), F.col("end"), *map(F.col, more))).alias("feature"))


def frequent(found: DataFrame, least: int) -> DataFrame:
    """(feature, n) of the features that occur so often."""
    return found.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def bilexical(arcs: DataFrame, sentences: DataFrame) -> DataFrame:
    """(sent_id, dependent, head, features) of arcs: head word, dependent word, both, side and
    distance, and these with both words' classes. The root's head is #."""
    rows = arcs.join(sentences.select("sent_id", F.transform("words", lambda w: F.coalesce(F.trim(w), F.lit(""))).alias("words")), "sent_id")
    h, d = at(F.col("words"), F.col("head")), at(F.col("words"), F.col("dependent"))
    gap = F.col("head") - F.col("dependent")
    n = F.abs(gap)
    dist = F.concat(F.when(gap > 0, "R").otherwise("L"), F.when(n <= 5, n.cast("string")).when(n <= 10, "6").otherwise("7"))
    parts = [F.concat(F.lit("h="), h), F.concat(F.lit("d="), d), F.concat(F.lit("hd="), h, F.lit(" "), d), F.concat(F.lit("dist="), dist),
             F.concat(F.lit("hdist="), h, F.lit(" "), dist), F.concat(F.lit("classes="), W.word_class(h), F.lit(" "), W.word_class(d), F.lit(" "), dist)]
    return rows.select("sent_id", "dependent", "head", F.array(*parts).alias("features"))


def class_bins(words: Column, begin: Column, end: Column, *_split) -> Column:
    """First-character bins of the words at the span's edges."""
    return F.array(F.concat(F.lit("bins="), char_bin(at(words, begin)), char_bin(at(words, end - 1))))


def parser_recipe() -> Featurizer:
    """The usual features of constituents: edge words and their neighbours, length, shape."""
    edges = total(*[marked("B", k) for k in (-1, 0)], *[marked("E", k) for k in (-1, 0)])
    return total(edges, product(marked("B", 0), marked("E", -1)), product(marked("B", -1), marked("E", 0)), product(length, edges), lambda w, b, e, *s: F.array(F.concat(F.lit("shape="), span_shape(w, b, e))))


def ner_recipe(cluster_of: Column | None = None) -> Featurizer:
    """The usual features of entities: words, shapes and clusters around the edges, affixes, length."""
    forms = [lambda w: w, W.shape] + ([] if cluster_of is None else [lambda w: F.coalesce(F.try_element_at(cluster_of, w), F.lit("-"))])
    around = [marked(p, k, f) for p in "BE" for k in (-2, -1, 0, 1) for f in forms]
    affix = lambda w, b, e, *s: F.concat(F.transform(W.prefixes(at(w, b)), lambda x: F.concat(F.lit("pre="), x)), F.transform(W.suffixes(at(w, e - 1)), lambda x: F.concat(F.lit("suf="), x)))
    return total(*around, product(marked("B", 0, W.shape), marked("B", 1, W.shape)), affix, length)
