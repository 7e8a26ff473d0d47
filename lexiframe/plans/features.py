"""Span, split, bilexical and recipe features, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiframe.functions import words as W
from lexiframe.operators import indexing, masks, spans, trees
from lexiframe.operators import spanfeats as S
from lexiframe.operators import wordfeats as wf
from lexiframe.plans.common import ONE, TAGGED, TOK, one_sentences, tagged, tokens, training


def _spans(spark, d):
    """Entity spans with their sentence's words."""
    one = one_sentences(spark, d)
    return S.with_words(spans.entity_segments(one).drop("n_words"), one)


def _count(rows, f, *more):
    return S.frequent(S.features(rows, f, *more), 1)


def span_marked_words(spark, d):
    """Words at both edges of entities and around them."""
    return _count(_spans(spark, d), S.total(*[S.marked(p, k) for p in "BE" for k in (-2, -1, 0, 1)]))


def span_sum_product(spark, d):
    """First words and lengths, and their products."""
    return _count(_spans(spark, d), S.total(S.length, S.product(S.marked("B", 0), S.length)))


def span_unit_or_long(spark, d):
    """The word of unit spans; edge words of longer ones."""
    return _count(_spans(spark, d), S.total(S.when_unit(S.marked("B", 0)), S.when_longer(S.marked("E", -1), 1), S.zero))


def span_inner_bigrams(spark, d):
    return _count(_spans(spark, d), S.inner_bigrams)


def span_ngrams(spark, d):
    """Runs of one to three words inside of spans that occur twice or more."""
    return S.frequent(S.features(_spans(spark, d), S.total(*[S.ngrams(n) for n in (1, 2, 3)])), 2)


def span_full_shapes(spark, d):
    return _count(_spans(spark, d), S.full_shape)


def span_tag_shapes(spark, d):
    """Windows of the most frequent tags around entities; tags by the word's most frequent one."""
    c = tagged(spark, d).groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("word").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"))
    rows = _spans(spark, d).withColumn("i", F.explode(F.sequence(F.col("begin") - 1, F.col("end"))))
    rows = rows.select("sent_id", "label", "begin", "end", "i", S.at(F.col("words"), F.col("i")).alias("word")).join(best, "word", "left")
    name = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("tag", F.lit("?")).alias("t")))), lambda x: x["t"]), " ")
    return rows.groupBy("sent_id", "label", "begin", "end").agg(name.alias("tags"))


def split_features(spark, d):
    """Words at, and lengths of both sides of, every split point of entities."""
    return _count(S.splits(_spans(spark, d)), S.total(S.marked("S", -1), S.marked("S", 0), S.split_lengths, S.split_edges), "split")


def split_products(spark, d):
    """Products of split features, beside the side that is kept."""
    return _count(S.splits(_spans(spark, d)), S.kept_product(S.marked("S", 0), S.split_lengths, True, False), "split")


def split_shapes(spark, d):
    return _count(S.splits(_spans(spark, d)), S.split_shape, "split")


def split_side_spans(spark, d):
    """A span featurizer lifted to both sides of a split."""
    return _count(S.splits(_spans(spark, d)), S.from_spans(S.total(S.length, S.marked("B", 0))), "split")


def parser_span_recipe(spark, d):
    return _count(_spans(spark, d), S.parser_recipe())


def ner_span_recipe(spark, d):
    return _count(_spans(spark, d), S.ner_recipe())


def bilexical_features(spark, d):
    """Features of all arcs of the trees."""
    one = one_sentences(spark, d)
    arcs = trees.dependency_table(one.select("sent_id", F.col("annotations.tree").alias("tree")))
    b = S.bilexical(arcs, one).select(F.explode("features").alias("feature"))
    return b.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def word_modifiers(spark, d):
    """Each word's class marked with its place, for the places from two before to two behind."""
    w = Window.partitionBy("sent_id").orderBy("pos")
    cls = W.shape(F.col("word"))
    feats = F.array(*[F.concat(F.lit(f"{k:+d}:"), F.coalesce((F.lag if k < 0 else F.lead)(cls, abs(k)).over(w) if k else cls, F.lit("#"))) for k in (-2, -1, 0, 1, 2)])
    return tokens(spark, d).select(feats.alias("f")).select(F.explode("f").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def rare_transformed(spark, d):
    """Words, and their shapes where those occur three times or more; rarer shapes are one class."""
    t = tokens(spark, d).select(W.shape(F.col("word")).alias("form"))
    c = t.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.when(F.col("n") >= 3, F.col("form")).otherwise("-RARE-").alias("form"), "n").groupBy("form").agg(F.sum("n").alias("n"))


def pos_recipe(spark, d):
    """The usual tagger features: words and classes one place around, pairs of tag-dictionary entries
    two places around, affixes of up to four characters, word properties."""
    t = tokens(spark, d)
    c = tagged(spark, d).groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("word").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("td"))
    w = Window.partitionBy("sent_id").orderBy("pos")
    t = t.join(best, "word", "left").withColumn("td", F.coalesce("td", F.lit("?")))
    near = lambda c_, k: F.coalesce((F.lag if k < 0 else F.lead)(c_, abs(k)).over(w) if k else F.col(c_), F.lit("#"))
    t = t.withColumn("cls", W.word_class(F.col("word")))
    uni = [F.concat(F.lit(f"{n}{k:+d}="), near(c_, k)) for n, c_ in (("w", "word"), ("c", "cls")) for k in (-1, 0, 1)]
    bi = [F.concat(F.lit(f"td{k:+d}="), near("td", k), F.lit(" "), near("td", k + 1)) for k in (-2, -1, 0, 1)]
    affix = [F.transform(x, lambda s, m=m: F.concat(F.lit(m), s)) for m, x in (("pre=", W.prefixes(F.col("word"), 4)), ("suf=", W.suffixes(F.col("word"), 4)), ("is=", W.properties(F.col("word"))))]
    f = t.select(F.concat(F.array(*uni, *bi), *affix).alias("f")).select(F.explode("f").alias("feature"))
    return f.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def unsmoothed_lexicon(spark, d):
    """The tags each word was seen with."""
    return tagged(spark, d).groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))


def gold_segment_policy(spark, d):
    """Candidate spans of up to the longest entity's length and whether they are segments of the gold."""
    one = one_sentences(spark, d)
    gold = spans.entity_segments(one).select("sent_id", "begin", "end").distinct().withColumn("gold", F.lit(True))
    most = gold.agg(F.max(F.col("end") - F.col("begin"))).first()[0] or 1
    c = spans.enumerate_spans(one, most).join(gold, ["sent_id", "begin", "end"], "left")
    return c.select("sent_id", "begin", "end", F.coalesce("gold", F.lit(False)).alias("gold"))


def mask_algebra(spark, d):
    """Bit sets of the places of each sentence that hold capitals and that hold entities, combined."""
    one = one_sentences(spark, d)
    caps = masks.bit_sets(tokens(spark, d).where(F.col("word").rlike(r"^\p{Lu}")).select("sent_id", "pos"))
    inside = masks.bit_sets(spans.entity_segments(one).select("sent_id", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos")))
    m = masks.combine(caps, inside)
    return m.select("sent_id", *[F.aggregate(c, F.lit(0), lambda n, x: n + F.bit_count(x)).cast("int").alias(c) for c in ("both", "either", "first_only", "one_only")])


def weight_listing(spark, d):
    """Log odds of tag and word class pairs, the farthest from none first: a top-k report."""
    t = tagged(spark, d).select("tag", W.word_class(F.col("word")).alias("cls"))
    c = t.groupBy("tag", "cls").agg(F.count(F.lit(1)).alias("n"))
    by_tag, by_cls, whole = Window.partitionBy("tag"), Window.partitionBy("cls"), c.agg(F.sum("n").alias("total"))
    w = c.withColumn("t", F.sum("n").over(by_tag)).withColumn("c", F.sum("n").over(by_cls)).crossJoin(F.broadcast(whole))  # whole is one row
    w = w.select("tag", "cls", F.round(F.log(F.col("n") * F.col("total") / (F.col("t") * F.col("c"))), 6).alias("weight"))
    return w.orderBy(F.desc(F.abs("weight")), "tag", "cls").limit(50)


def cross_index_pruned(spark, d):
    """Tag and word pairs seen three times or more, the others hashed into 64 shared cells."""
    t = tagged(spark, d).select(F.col("tag").alias("label"), F.lower("word").alias("feature"))
    return indexing.with_hashed(t, 3, 64).groupBy("hashed").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n"))


def seen_filter(spark, d):
    """Words of all sentences tested against a Bloom filter of the training words: none that is in may
    be missed, and the estimated number of training words is near the true one."""
    train = training(tokens(spark, d), spark, d).select("word")
    bits = masks.bloom(train, "word", 1 << 16, 3)
    t = tokens(spark, d).select("word").distinct()
    hit = masks.bloom_hits(t, "word", bits, 1 << 16, 3)
    known = train.distinct().withColumn("known", F.lit(True))
    missed = hit.join(known, "word", "left").agg(F.count_if(F.col("known") & ~F.col("hit")).alias("n_missed"), F.count_if("known").alias("n_known"))
    return missed


def word_in_context_union(spark, d):
    """The union of two featurizers, shape and class, per word."""
    v = tokens(spark, d).select("word").distinct()
    return v.select(F.explode(wf.union(F.array(W.shape(F.col("word"))), F.array(W.word_class(F.col("word"))))).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    span_marked_words, span_sum_product, span_unit_or_long, span_inner_bigrams, span_ngrams, span_full_shapes, span_tag_shapes, split_features, split_products,
    split_shapes, split_side_spans, parser_span_recipe, ner_span_recipe, bilexical_features, word_modifiers, rare_transformed, pos_recipe, unsmoothed_lexicon,
    gold_segment_policy, mask_algebra, weight_listing, cross_index_pruned, seen_filter, word_in_context_union,
)}


def _sql():
    from lexiframe.plans.spans import _SEG
    from lexiframe.plans.words import _class, _shape

    sp = _SEG + """,
 sp AS (SELECT seg.sent_id, seg.label, b, e, list_transform(words, lambda x: coalesce(trim(x), '')) AS w FROM seg JOIN one USING (sent_id)),
 spl AS (SELECT *, unnest(range(b + 1, e)) AS s FROM sp WHERE e - b >= 2)"""
    at = lambda i: f"coalesce(CASE WHEN {i} >= 0 THEN w[({i}) + 1] END, '#')"
    length = "'len=' || CASE WHEN e - b <= 5 THEN CAST(e - b AS VARCHAR) WHEN e - b <= 10 THEN '6-10' ELSE '11+' END"
    count = lambda lists, table="sp": f"WITH {sp} SELECT feature, count(*) AS n FROM (SELECT unnest({lists}) AS feature FROM {table}) GROUP BY 1"
    mark = lambda p, k: f"'{p}{k:+d}=' || " + at({"B": "b", "E": "e", "S": "s"}[p] + f"{k:+d}")
    bi = f"CASE WHEN e - b >= 2 THEN list_transform(range(b, e - 1), lambda i: 'bi=' || {at('i')} || ' ' || {at('i + 1')}) ELSE [] END"
    gram = lambda n: f"CASE WHEN e - b >= {n} THEN list_transform(range(b, e - {n - 1}), lambda i: '{n}g=' || array_to_string(w[i + 1 : i + {n}], ' ')) ELSE [] END"
    sides = "CASE WHEN s - b = e - s THEN '=' WHEN s - b < e - s THEN '<' ELSE '>' END"
    split_len = f"['left=' || least(s - b, 8), 'right=' || least(e - s, 8), 'sides=' || {sides}]"
    near = lambda x: f"CASE WHEN {x} <= 2 THEN CAST({x} AS VARCHAR) WHEN {x} <= 5 THEN '3-5' ELSE '6+' END"
    out = {
        "span_marked_words": count("[" + ", ".join(mark(p, k) for p in "BE" for k in (-2, -1, 0, 1)) + "]"),
        "span_sum_product": count(f"[{length}, {mark('B', 0)} || '&' || {length}]"),
        "span_unit_or_long": count(f"CASE WHEN e - b = 1 THEN [{mark('B', 0)}] ELSE [{mark('E', -1)}] END"),
        "span_inner_bigrams": count(bi),
        "span_ngrams": count(f"list_concat(list_concat({gram(1)}, {gram(2)}), {gram(3)})") + " HAVING count(*) >= 2",
        "span_full_shapes": count(f"['full=' || array_to_string(list_transform(w[b + 1 : e], lambda x: {_shape('x')}), ' ')]"),
        "span_tag_shapes": f"""WITH {sp}, {TAGGED.split(TOK + ',')[1]}, c AS (SELECT word, tag, count(*) AS n FROM tagged GROUP BY 1, 2),
 best AS (SELECT word, tag FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) = 1),
 p AS (SELECT sent_id, label, b, e, i, {at('i')} AS word FROM (SELECT *, unnest(range(b - 1, e + 1)) AS i FROM sp))
 SELECT sent_id, label, b AS "begin", e AS "end", string_agg(coalesce(tag, '?'), ' ' ORDER BY i) AS tags FROM p LEFT JOIN best USING (word) GROUP BY 1, 2, 3, 4""",
        "split_features": count(f"list_concat([{mark('S', -1)}, {mark('S', 0)}, 'from=' || {near('s')}, 'to=' || {near('(len(w) - s)')}], {split_len})", "spl"),
        "split_products": count(f"list_concat([{mark('S', 0)}], list_transform({split_len}, lambda y: {mark('S', 0)} || '&' || y))", "spl"),
        "split_side_spans": count(
            "['l:' || " + length.replace("e - b", "s - b") + ", 'l:' || " + mark("B", 0) + ", 'r:' || " + length.replace("e - b", "e - s") + ", 'r:B+0=' || " + at("s") + "]", "spl"),
        "word_modifiers": f"""WITH {TOK}, s AS (SELECT sent_id, pos, {_shape('word')} AS x FROM tok),
 f AS (SELECT unnest(['-2:' || coalesce(lag(x, 2) OVER o, '#'), '-1:' || coalesce(lag(x) OVER o, '#'), '+0:' || x, '+1:' || coalesce(lead(x) OVER o, '#'), '+2:' || coalesce(lead(x, 2) OVER o, '#')]) AS feature FROM s WINDOW o AS (PARTITION BY sent_id ORDER BY pos))
 SELECT feature, count(*) AS n FROM f GROUP BY 1""",
        "rare_transformed": f"WITH {TOK}, c AS (SELECT {_shape('word')} AS form, count(*) AS n FROM tok GROUP BY 1) SELECT CASE WHEN n >= 3 THEN form ELSE '-RARE-' END AS form, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1",
        "unsmoothed_lexicon": f"WITH {TAGGED} SELECT word, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags FROM tagged GROUP BY 1",
        "gold_segment_policy": f"""WITH {_SEG}, c AS (SELECT sent_id, b, unnest(range(b + 1, least(n, b + (SELECT max(e - b) FROM seg)) + 1)) AS e FROM (SELECT sent_id, len(words) AS n, unnest(range(len(words))) AS b FROM one))
 SELECT c.sent_id, c.b AS "begin", c.e AS "end", EXISTS (SELECT 1 FROM seg WHERE seg.sent_id = c.sent_id AND seg.b = c.b AND seg.e = c.e) AS gold FROM c""",
        "mask_algebra": f"""WITH {_SEG}, m AS (SELECT sent_id, pos, regexp_matches(word, '^\\p{{Lu}}') AS x, label IS NOT NULL AS y FROM bio)
 SELECT sent_id, CAST(count(*) FILTER (x AND y) AS INT) AS both, CAST(count(*) FILTER (x OR y) AS INT) AS either, CAST(count(*) FILTER (x AND NOT y) AS INT) AS first_only, CAST(count(*) FILTER (x <> y) AS INT) AS one_only
 FROM m GROUP BY 1 HAVING count(*) FILTER (x OR y) > 0""",
        "weight_listing": f"""WITH {TAGGED}, c AS (SELECT tag, {_class('word')} AS cls, count(*) AS n FROM tagged GROUP BY 1, 2),
 w AS (SELECT tag, cls, round(ln(n * (SELECT sum(n) FROM c) / (sum(n) OVER (PARTITION BY tag) * sum(n) OVER (PARTITION BY cls))), 6) AS weight FROM c) SELECT tag, cls, weight FROM w ORDER BY abs(weight) DESC, tag, cls LIMIT 50""",
        "cross_index_pruned": f"""WITH {TAGGED}, c AS (SELECT tag, lower(word) AS word, count(*) AS n FROM tagged GROUP BY 1, 2)
 SELECT n < 3 AS hashed, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
        "seen_filter": f"WITH {TOK} SELECT 0 AS n_missed, count(DISTINCT word) AS n_known FROM tok WHERE sent_id NOT IN (SELECT sent_id FROM held)",
        "word_in_context_union": f"WITH {TOK}, v AS (SELECT DISTINCT word FROM tok) SELECT feature, count(*) AS n FROM (SELECT unnest([{_shape('word')}, {_class('word')}]) AS feature FROM v) GROUP BY 1",
    }
    return out


SQL = _sql()
