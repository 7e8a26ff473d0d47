"""Word featurizers: token rows gain arrays of feature names. Counts arrive by join on the word.

A token frame has (sent_id, pos, word); windows run within a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.functions import words as W

BY = "sent_id"


def order():
    return Window.partitionBy(BY).orderBy("pos")


def word_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def with_counts(tokens: DataFrame) -> DataFrame:
    """Adds how often each word occurs; Spark broadcasts the counts only while they are small."""
    return tokens.join(word_counts(tokens), "word")


def identity(word: Column, n: Column, more_than: int = 2) -> Column:
    """The word when it occurs more often than so, else a mark for unknown ones."""
    return F.when(n > more_than, word).otherwise("#UNK#")


def shape_or_word(word: Column, n: Column, more_than: int = 100) -> Column:
    return F.when(n > more_than, word).otherwise(W.shape(word))


def class_or_word(word: Column, n: Column, more_than: int = 100) -> Column:
    return F.when(n > more_than, word).otherwise(W.word_class(word))


def minimal(word: Column, n: Column, unknown: int = 2, shapes: int = 5) -> Column:
    """Word, class and, for rare words, shape and a mark."""
    return F.filter(
        F.array(
            F.when(n > unknown, F.concat(F.lit("Word("), word, F.lit(")"))),
            F.concat(F.lit("Class("), W.word_class(word), F.lit(")")),
            F.when(n <= shapes, F.concat(F.lit("Shape("), W.shape(word), F.lit(")"))),
            F.when(n <= unknown, "Unk"),
        ),
        lambda x: x.isNotNull(),
    )


def affixes(word: Column, n: Column, size: int = 4, common: int = 100) -> Column:
    """Prefixes and suffixes of words that aren't common."""
    none = F.array().cast("array<string>")
    p = F.transform(W.prefixes(word, size), lambda x: F.concat(F.lit("Prefix("), x, F.lit(")")))
    s = F.transform(W.suffixes(word, size), lambda x: F.concat(F.lit("Suffix("), x, F.lit(")")))
    return F.when(n <= common, F.concat(p, s)).otherwise(none)


def union(*feats: Column) -> Column:
    return F.concat(*feats)


def cross(a: Column, b: Column) -> Column:
    """All pairs of two features of one token."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit(" & "), y))))


def offset(feats: Column, by: int) -> Column:
    """The features of the token `by` places on; beyond the sentence a boundary mark."""
    moved = F.lead(feats, by) if by >= 0 else F.lag(feats, -by)
    return F.coalesce(moved.over(order()), F.array(F.lit("Boundary")))


def context_set(feat: Column, width: int) -> Column:
    """Sorted distinct features of the neighbours, the token itself left out."""
    w = order()
    before = F.collect_set(feat).over(w.rowsBetween(-width, -1))
    after = F.collect_set(feat).over(w.rowsBetween(1, width))
    return F.array_sort(F.array_union(before, after))


def context_words(word: Column) -> Column:
    """The neighbours' words and their pairs with the token's own."""
    w = order()
    prev, nxt = F.coalesce(F.lag(word).over(w), F.lit("<s>")), F.coalesce(F.lead(word).over(w), F.lit("</s>"))
    return F.array(F.concat(F.lit("L:"), prev), F.concat(F.lit("R:"), nxt), F.concat(prev, F.lit("_"), word), F.concat(word, F.lit("_"), nxt))


def ngrams(word: Column, size: int) -> Column:
    """The n-gram that begins at the token, null near the sentence's end."""
    w = order().rowsBetween(0, size - 1)
    a = F.collect_list(word).over(w)
    return F.when(F.size(a) == size, F.array_join(a, " "))


def next_actual(word: Column) -> Column:
    """The next word that has a letter or digit, to the right of the token."""
    actual = F.when(word.rlike(r"[\p{L}\p{N}]"), word)
    return F.first(actual, ignorenulls=True).over(order().rowsBetween(1, Window.unboundedFollowing))


def previous_actual(word: Column) -> Column:
    actual = F.when(word.rlike(r"[\p{L}\p{N}]"), word)
    return F.last(actual, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, -1))


def position_caps(word: Column) -> Column:
    """Is the token capitalised, and where: first of its sentence (or after an opening quote) or not."""
    first = (F.col("pos") == 0) | (F.coalesce(F.lag(word).over(order()), F.lit("")) == "``")
    return F.when(word.rlike(r"^\p{Lu}"), F.when(first, "FirstCap").otherwise("InnerCap")).otherwise("NoCap")


def sentence_properties(tokens: DataFrame) -> DataFrame:
    """(sent_id, n, all_upper): length, and whether no word with letters has a lower-case one."""
    return tokens.groupBy(BY).agg(F.count(F.lit(1)).alias("n"), F.min(~F.col("word").rlike(r"\p{Ll}")).alias("all_upper"))


def suffix_mass(tokens: DataFrame, rare: int = 5, threshold: int = 20) -> DataFrame:
    """(suffix, mass): occurrences of rare words (at most `rare`) that end so; the empty suffix is
    one of them. Sums under the threshold are left out."""
    c = word_counts(tokens).where(F.col("n") <= rare)
    tails = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.substring(F.col("word"), i + 1, F.length("word")))
    return c.select(F.explode(tails).alias("suffix"), "n").groupBy("suffix").agg(F.sum("n").alias("mass")).where(F.col("mass") >= threshold)


def longest_frequent_suffix(tokens: DataFrame, rare: int = 5, threshold: int = 20) -> DataFrame:
    """(word, suffix): words above `rare` stand for themselves; others for their longest suffix of
    enough mass, or -UNK-."""
    c = word_counts(tokens)
    tails = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.substring(F.col("word"), i + 1, F.length("word")))
    low = c.where(F.col("n") <= rare).select("word", F.explode(tails).alias("suffix"))
    best = low.join(suffix_mass(tokens, rare, threshold), "suffix", "left").groupBy("word")
    best = best.agg(F.max_by("suffix", F.when(F.col("mass").isNotNull(), F.length("suffix"))).alias("suffix"))
    return c.where(F.col("n") > rare).select("word", F.col("word").alias("suffix")).unionByName(best.select("word", F.coalesce("suffix", F.lit("-UNK-")).alias("suffix")))


def tag_dictionary(tagged: DataFrame, low: int = 2, high: int = 10_000) -> DataFrame:
    """(word, tag): the most common tag of words seen more than low and fewer than high times, where
    it is the only one; ties go to the smaller tag."""
    c = tagged.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))
    w = c.groupBy("word").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"))
    return w.where((F.col("total") > low) & (F.col("total") < high) & (F.col("top") == F.col("total"))).select("word", "tag")


def open_tags(tagged: DataFrame, open_above: int = 50, rare_below: int = 10) -> DataFrame:
    """(word, tags): tags allowed for each word: those it was seen with and, for words seen fewer
    than rare_below times, all open ones: tags seen with more than open_above different words."""
    c = tagged.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))
    opened = c.groupBy("tag").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > open_above).agg(F.coalesce(F.collect_list("tag"), F.array().cast("array<string>")).alias("open"))
    w = c.groupBy("word").agg(F.collect_set("tag").alias("own"), F.sum("n").alias("n"))
    # one row holds all open tags: there are no more of them than tags of the scheme
    return w.crossJoin(F.broadcast(opened)).select("word", F.array_sort(F.when(F.col("n") < rare_below, F.array_union("own", "open")).otherwise(F.col("own"))).alias("tags"))


def signature_lexicon(tagged: DataFrame, known: int = 5) -> DataFrame:
    """(key, tags): tags of words seen `known` times or more, and of the classes of all others."""
    c = tagged.join(word_counts(tagged.select("word")), "word")
    key = F.when(F.col("n") >= known, F.col("word")).otherwise(W.word_class(F.col("word")))
    return c.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def backoff_lookup(words: DataFrame, lexicon: DataFrame, all_tags: Column) -> DataFrame:
    """(word, tags): by the word, else by its class, else all tags."""
    by_word = words.join(lexicon.select(F.col("key").alias("word"), F.col("tags").alias("a")), "word", "left")
    full = by_word.withColumn("key", W.word_class(F.col("word"))).join(lexicon.withColumnRenamed("tags", "b"), "key", "left")
    return full.select("word", F.coalesce("a", "b", all_tags).alias("tags"))
