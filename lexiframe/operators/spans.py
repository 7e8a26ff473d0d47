"""Spans over tokens: segments, BIO tags, enumeration, shapes, masks, n-grams and negation scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that open a negation and marks that close it.
NEGATORS = ("not", "n't")
NEGATION_ENDS = (".", ",", ";", "--", ":")


def order():
    return Window.partitionBy("sent_id").orderBy("pos")


def entity_segments(sentences: DataFrame) -> DataFrame:
    """(sent_id, label, begin, end, n_words): distinct entity spans inside their sentence that no
    earlier (begin, end, label) one of the sentence overlaps."""
    e = sentences.select("sent_id", F.size("words").alias("n_words"), F.explode("annotations.ner").alias("e"))
    e = e.select("sent_id", F.col("e.ner_type").alias("label"), F.col("e.span_begin").alias("begin"), F.col("e.span_end").alias("end"), "n_words").distinct()
    e = e.where("label is not null and begin >= 0 and begin < end and end <= n_words")
    w = Window.partitionBy("sent_id").orderBy("begin", "end", "label").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("before", F.coalesce(F.max("end").over(w), F.lit(0))).where("begin >= before").drop("before")


def with_segments(sentences: DataFrame) -> DataFrame:
    """Adds `segments`, ARRAY<STRUCT<begin, end, label>> in order: entity_segments of the row itself."""
    e = F.transform("annotations.ner", lambda e: F.struct(e["span_begin"].alias("begin"), e["span_end"].alias("end"), e["ner_type"].alias("label")))
    e = F.filter(e, lambda x: x["label"].isNotNull() & (x["begin"] >= 0) & (x["begin"] < x["end"]) & (x["end"] <= F.size("words")))
    s = sentences.withColumn("spans", F.array_sort(F.array_distinct(e)))
    before = lambda i: F.coalesce(F.array_max(F.transform(F.slice("spans", F.lit(1), i), lambda y: y["end"])), F.lit(0))
    return s.withColumn("segments", F.filter("spans", lambda x, i: x["begin"] >= before(i))).drop("spans")


def filled_segments(number) -> Column:
    """ARRAY<STRUCT<begin, end, label>> of `segments` and of a unit segment 0 for every one of `words` outside
    of them, in order: fill_gaps of the row itself. number gives a label's number."""
    own = F.transform("segments", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), number(s["label"]).alias("label")))
    inside = F.flatten(F.transform("segments", lambda s: F.sequence(s["begin"], s["end"] - 1)))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i < F.size("words")) & ~F.array_contains(inside, i))
    gaps = F.transform(places, lambda i: F.struct(i.alias("begin"), (i + 1).alias("end"), F.lit(0).alias("label")))
    return F.array_sort(F.concat(F.coalesce(own, F.slice(gaps, 1, 0)), F.coalesce(gaps, F.slice(own, 1, 0))))


def bio_encode(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """(sent_id, pos, bio): B-label at a segment's first token, I-label inside, O outside."""
    marks = segments.select("sent_id", "label", "begin", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"))
    t = tokens.select("sent_id", "pos").join(marks, ["sent_id", "pos"], "left")
    bio = F.when(F.col("label").isNull(), "O").when(F.col("pos") == F.col("begin"), F.concat(F.lit("B-"), "label")).otherwise(F.concat(F.lit("I-"), "label"))
    return t.select("sent_id", "pos", bio.alias("bio"))


def bio_decode(bio: DataFrame) -> DataFrame:
    """(sent_id, label, begin, end): segments of BIO rows; an I whose label differs from the running
    one begins a new segment; each outside token is a unit segment labelled O."""
    kind, label = F.substring("bio", 1, 1), F.when(F.col("bio") == "O", "O").otherwise(F.substring(F.col("bio"), F.lit(3), F.length("bio")))
    b = bio.select("sent_id", "pos", kind.alias("kind"), label.alias("label"))
    new = (F.col("kind") != "I") | (F.lag("label").over(order()).isNull()) | (F.lag("label").over(order()) != F.col("label"))
    g = b.withColumn("new", new.cast("int")).withColumn("grp", F.sum("new").over(order()))
    return g.groupBy("sent_id", "grp").agg(F.first("label").alias("label"), F.min("pos").alias("begin"), (F.max("pos") + 1).alias("end")).drop("grp")


def fill_gaps(segments: DataFrame, tokens: DataFrame) -> DataFrame:
    """Segments plus a unit segment O for every token outside of them."""
    covered = segments.select("sent_id", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"))
    gaps = tokens.select("sent_id", "pos").join(covered, ["sent_id", "pos"], "left_anti")
    return segments.select("sent_id", "label", "begin", "end").unionByName(gaps.select("sent_id", F.lit("O").alias("label"), F.col("pos").alias("begin"), (F.col("pos") + 1).alias("end")))


def filter_words(tokens: DataFrame, segments: DataFrame, keep: Column) -> DataFrame:
    """Segments re-indexed to the words that `keep` holds for; those without any are dropped."""
    kept = keep.cast("int")
    at = F.sum(kept).over(order().rowsBetween(Window.unboundedPreceding, -1))
    t = tokens.withColumn("k", kept).withColumn("new", F.coalesce(at, F.lit(0)).cast("int")).select("sent_id", "pos", "k", "new")
    s = segments.select("sent_id", "label", "begin", "end", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos")).join(t, ["sent_id", "pos"])
    g = s.groupBy("sent_id", "label", "begin", "end").agg(F.min("new").alias("new_begin"), F.sum("k").alias("n"))
    return g.where("n > 0").select("sent_id", "label", F.col("new_begin").alias("begin"), (F.col("new_begin") + F.col("n")).cast("int").alias("end"))


def flat_tags(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """(sent_id, pos, label): the label of the covering segment or O."""
    marks = segments.select("sent_id", "label", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"))
    return tokens.select("sent_id", "pos").join(marks, ["sent_id", "pos"], "left").select("sent_id", "pos", F.coalesce("label", F.lit("O")).alias("label"))


def enumerate_spans(sentences: DataFrame, longest: int | None = None) -> DataFrame:
    """(sent_id, begin, end): all spans, or those of up to `longest` tokens."""
    s = sentences.where(F.size("words") > 0).select("sent_id", F.size("words").alias("n"))
    s = s.select("sent_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("begin"))
    last = F.col("n") if longest is None else F.least(F.col("n"), F.col("begin") + longest)
    return s.select("sent_id", "begin", F.explode(F.sequence(F.col("begin") + 1, last)).alias("end"))


def char_bin(w: Column) -> Column:
    """X, x or d by the first character; marks stand for themselves; escaped brackets for brackets."""
    from lexiframe.functions.words import unescape_bracket

    c = F.substring(unescape_bracket(w), 1, 1)
    return F.when(c.rlike(r"\p{Lu}"), "X").when(c.rlike(r"\p{L}"), "x").when(c.rlike(r"\p{N}"), "d").otherwise(c)


def span_shape(words: Column, begin: Column, end: Column, longest: int = 6) -> Column:
    """First-character bins of a span in its context, `a[bcd]e`; # beyond the sentence; of long
    spans the first and last ones with ~ between."""
    bins = F.transform(words, lambda w: F.coalesce(char_bin(w), F.lit("")))
    inner = F.slice(bins, begin + 1, end - begin)
    half = longest // 2
    short = F.array_join(inner, "")
    cut = F.concat(F.array_join(F.slice(inner, 1, half), ""), F.lit("~"), F.array_join(F.slice(inner, -half, half), ""))
    left = F.when(begin > 0, F.try_element_at(bins, F.greatest(begin, F.lit(1)))).otherwise("#")
    right = F.when(end < F.size(words), F.try_element_at(bins, end + 1)).otherwise("#")
    return F.concat(left, F.lit("["), F.when(end - begin > longest, cut).otherwise(short), F.lit("]"), right)


def negation_scope(tokens: DataFrame) -> DataFrame:
    """(sent_id, pos, negated): is the token after a negator with no closing mark between? The
    negator and the closing mark aren't themselves."""
    low = F.lower("word")
    event = F.when(low.isin(*NEGATORS), 1).when(low.isin(*NEGATION_ENDS), 0)
    state = F.last(event, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0))
    return tokens.select("sent_id", "pos", (event.isNull() & (F.coalesce(state, F.lit(0)) == 1)).alias("negated"))


def quote_state(tokens: DataFrame) -> DataFrame:
    """(sent_id, pos, inside): is a plain quote open at the token? By parity of the quotes before it."""
    quotes = F.sum((F.col("word") == '"').cast("int")).over(order().rowsBetween(Window.unboundedPreceding, 0))
    return tokens.select("sent_id", "pos", (F.pmod(quotes, F.lit(2)) == 1).alias("inside"))


def mask(allowed: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (sent_id, begin, end) that a mask of such rows allows."""
    return spans.join(allowed.select("sent_id", "begin", "end").distinct(), ["sent_id", "begin", "end"], "left_semi")


def layered_mask(spans: DataFrame, unit: DataFrame, longest: DataFrame) -> DataFrame:
    """(sent_id, begin, end, label) that begin and go on with tokens where the label is allowed.

    unit (sent_id, pos, label): labels allowed per token; longest (label, most): greatest length.
    """
    first = unit.select("sent_id", F.col("pos").alias("begin"), "label")
    second = unit.select("sent_id", (F.col("pos") - 1).alias("begin"), F.col("label").alias("label"))
    s = spans.join(first, ["sent_id", "begin"]).join(longest, "label").where(F.col("end") - F.col("begin") <= F.col("most"))
    long = s.where(F.col("end") - F.col("begin") > 1).join(second, ["sent_id", "begin", "label"], "left_semi")
    return s.where(F.col("end") - F.col("begin") == 1).unionByName(long).select("sent_id", "begin", "end", "label")


def gazetteer_words(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """(sent_id, pos, types): types of the entries (type, words) with the token, sorted; of those
    that end in it also END-type."""
    one = entries.select("type", F.posexplode("words").alias("i", "word"), F.size("words").alias("n"))
    types = one.select("word", F.explode(F.when(F.col("i") == F.col("n") - 1, F.array("type", F.concat(F.lit("END-"), "type"))).otherwise(F.array("type"))).alias("t"))
    per = types.groupBy("word").agg(F.array_sort(F.collect_set("t")).alias("types"))
    return tokens.join(per, "word").select("sent_id", "pos", "types")


def gazetteer_spans(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """(sent_id, begin, end, type): stretches of tokens that are a whole entry (type, words).

    A token opens one key per length that occurs among the entries; they are all joined at once.
    """
    keys = entries.select(F.array_join("words", " ").alias("key"), F.size("words").alias("n"), "type").groupBy("key", "n").agg(F.max("type").alias("type"))
    sizes = sorted(r[0] for r in keys.select("n").distinct().collect())  # as many as there are lengths
    if not sizes:
        return tokens.select("sent_id", F.col("pos").alias("begin"), F.col("pos").alias("end"), F.col("word").alias("type")).limit(0)
    ahead = F.collect_list("word").over(order().rowsBetween(0, sizes[-1] - 1))
    lengths = F.filter(F.lit(sizes), lambda n: n <= F.size("ahead"))
    grams = F.transform(lengths, lambda n: F.struct(n.alias("n"), F.array_join(F.slice("ahead", F.lit(1), n), " ").alias("key")))
    t = tokens.withColumn("ahead", ahead).select("sent_id", F.col("pos").alias("begin"), F.inline(grams))
    return t.join(keys, ["key", "n"]).select("sent_id", "begin", (F.col("begin") + F.col("n")).alias("end"), "type")
