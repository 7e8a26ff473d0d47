"""Segments, spans, feature dictionaries, counts and evaluation over annotated sentences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiframe.functions import maths
from lexiframe.operators import evaluation, indexing, spans
from lexiframe.plans.common import ONE, TAG, TAGGED, TOK, delivered, held_out, held_sections, one_sentences, tagged, tags, tokens, training
from lexiframe.session import grows, table


def _segments(spark, d):
    return spans.entity_segments(one_sentences(spark, d))


def entity_segments(spark, d):
    return _segments(spark, d).drop("n_words")


def bio_encode(spark, d):
    return spans.bio_encode(tokens(spark, d), _segments(spark, d))


def bio_decode(spark, d):
    return spans.bio_decode(bio_encode(spark, d))


def segment_gaps(spark, d):
    return spans.fill_gaps(_segments(spark, d), tokens(spark, d))


def filter_words_reindex(spark, d):
    return spans.filter_words(tokens(spark, d), _segments(spark, d), F.col("word").rlike(r"[\p{L}]"))


def flat_tags(spark, d):
    return spans.flat_tags(tokens(spark, d), _segments(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def max_segment_length(spark, d):
    return _segments(spark, d).groupBy("label").agg(F.max(F.col("end") - F.col("begin")).alias("most"), F.count(F.lit(1)).alias("n"))


def _candidates(spark, d):
    """All spans of up to as many tokens as the longest entity has; of one token where there is none."""
    most = _segments(spark, d).agg(F.max(F.col("end") - F.col("begin"))).first()[0]  # one number
    return spans.enumerate_spans(one_sentences(spark, d), most or 1)


def span_enumeration(spark, d):
    """Spans up to the longest entity's length."""
    return _candidates(spark, d)


def span_length_bins(spark, d):
    """All spans by length."""
    s = spans.enumerate_spans(one_sentences(spark, d))
    return s.groupBy(maths.distance_bin(F.col("end") - F.col("begin")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def span_shapes(spark, d):
    s = _segments(spark, d).join(one_sentences(spark, d).select("sent_id", F.transform("words", lambda w: F.coalesce(F.trim(w), F.lit(""))).alias("words")), "sent_id")
    return s.select("sent_id", "label", "begin", "end", spans.span_shape(F.col("words"), F.col("begin"), F.col("end")).alias("shape"))


def _word(i):
    return F.coalesce(F.trim(F.get("words", i)), F.lit(""))


def span_edges(spark, d):
    """First and last word of each entity, crossed. Segments are found in the sentence's row, and of its
    words only those at their edges are shuffled."""
    s = spans.with_segments(delivered(spark, d))
    at = F.array_distinct(F.flatten(F.transform("segments", lambda x: F.array(x["begin"], x["end"] - 1))))
    words = F.map_from_entries(F.transform(at, lambda i: F.struct(i, _word(i))))
    seg = grows(s.select("sent_id", "segments").dropDuplicates(["sent_id"]).where(F.size("segments") > 0))
    j = seg.join(grows(s.select("sent_id", words.alias("words")).dropDuplicates(["sent_id"])), "sent_id").select("words", F.inline("segments"))
    edges = F.concat_ws(" & ", F.try_element_at("words", F.col("begin")), F.try_element_at("words", F.col("end") - 1))
    return j.groupBy("label", edges.alias("edges")).agg(F.count(F.lit(1)).alias("n"))


def span_mask(spark, d):
    return spans.mask(_segments(spark, d), _candidates(spark, d))


def layered_span_mask(spark, d):
    seg = _segments(spark, d)
    unit = seg.select("sent_id", "label", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos")).distinct()
    longest = seg.groupBy("label").agg(F.max(F.col("end") - F.col("begin")).alias("most"))
    s = spans.layered_mask(_candidates(spark, d), unit, longest)
    return s.groupBy("label", (F.col("end") - F.col("begin")).alias("len")).agg(F.count(F.lit(1)).alias("n"))


def crossing_spans(spark, d):
    """Pairs of an entity and a mention that cross, per sentence."""
    m = one_sentences(spark, d).select("sent_id", F.explode("annotations.coref").alias("m")).select("sent_id", F.col("m.span_begin").alias("mb"), F.col("m.span_end").alias("me")).distinct()
    j = _segments(spark, d).join(m, "sent_id")
    b, e, mb, me = F.col("begin"), F.col("end"), F.col("mb"), F.col("me")
    return j.agg(F.count_if(maths.span_contains(b, e, mb, me)).alias("n_inside"), F.count_if(maths.span_crosses(b, e, mb, me)).alias("n_cross"), F.count(F.lit(1)).alias("n"))


def negation_scope(spark, d):
    t = tokens(spark, d).withColumn("word", F.when(F.lower("word") == "nothing", "not").otherwise(F.col("word")))
    return spans.negation_scope(t)


def quote_state(spark, d):
    return spans.quote_state(tokens(spark, d)).groupBy("sent_id").agg(F.count_if("inside").alias("n"))


def _gazetteer(spark, d):
    """Entries from the gold entities of the training sentences: label and words; in the sentence's row."""
    words = lambda s: F.transform(F.slice("words", s["begin"] + 1, s["end"] - s["begin"]), lambda w: F.coalesce(F.trim(w), F.lit("")))
    entries = F.transform("segments", lambda s: F.struct(s["label"].alias("type"), words(s).alias("words")))
    s = spans.with_segments(delivered(spark, d)).select("sent_id", "section_id", entries.alias("entries")).dropDuplicates(["sent_id"])
    s = s.where(F.size("entries") > 0).join(held_sections(spark, d), "section_id", "left_anti")
    return grows(s.select(F.inline("entries")).distinct())


def gazetteer_word(spark, d):
    """Types of the tokens of all sentences."""
    g = spans.gazetteer_words(tokens(spark, d), _gazetteer(spark, d))
    return g.select("sent_id", "pos", F.array_join("types", " ").alias("types"))


def gazetteer_span(spark, d):
    """Entries in all sentences."""
    return spans.gazetteer_spans(tokens(spark, d), _gazetteer(spark, d))


def _features(spark, d):
    return tokens(spark, d).select(F.col("sent_id").alias("context"), F.lower("word").alias("feature"))


def feature_index(spark, d):
    return indexing.feature_index(_features(spark, d), 2)


def feature_encode(spark, d):
    f = _features(spark, d)
    return indexing.encode(f, indexing.feature_index(f, 3)).groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))


def nonredundant_features(spark, d):
    return indexing.non_redundant(_features(spark, d))


def cross_index(spark, d):
    t = tagged(spark, d).select(F.col("tag").alias("label"), F.lower("word").alias("feature"))
    return indexing.cross_index(t, 3)


def segmented_index(spark, d):
    t = tagged(spark, d)
    a = indexing.feature_index(t.select(F.col("tag").alias("feature")))
    b = indexing.feature_index(t.select(F.lower("word").alias("feature")), 5)
    return indexing.segmented([a, b])


def label_word_counts(spark, d):
    return tagged(spark, d).groupBy("tag", "word").agg(F.count(F.lit(1)).alias("n"))


def marginal_counts(spark, d):
    """Sums of the tag by word counts over either axis and over both: one row per tag, per word, and one for all."""
    c = tagged(spark, d).groupBy("tag", F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    sums = c.groupingSets([[F.col("tag")], [F.col("word")], []], "tag", "word")
    return sums.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_cells"))


def log_normalize(spark, d):
    c = label_word_counts(spark, d)
    p = evaluation.normalize(F.col("n"), Window.partitionBy("tag"))
    return c.select("tag", "word", F.round(p, 6).alias("logp"))


def most_common_label(spark, d):
    c = label_word_counts(spark, d)
    return c.groupBy("word").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"), F.max("n").alias("n"))


def tag_transitions(spark, d):
    w = Window.partitionBy("sent_id").orderBy("pos")
    t = tags(spark, d).select(F.coalesce(F.lag("tag").over(w), F.lit("<s>")).alias("prev"), F.col("tag").alias("cur"))
    c = t.groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("n"))
    return c.select("prev", "cur", "n", F.round(evaluation.normalize(F.col("n"), Window.partitionBy("prev")), 6).alias("logp"))


def _baseline(spark, d):
    """(sent_id, pos, gold, pred): the most common tag of each word in the training sentences, for the held-out ones."""
    t = tagged(spark, d)
    c = training(t, spark, d).groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("word").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("pred"))
    odd = held_out(t, spark, d)
    return odd.join(best, "word", "left").select("sent_id", "pos", F.col("tag").alias("gold"), F.coalesce("pred", F.lit("NN")).alias("pred"))


def tagging_eval(spark, d):
    return evaluation.tagging(_baseline(spark, d))


def confusion_matrix(spark, d):
    return evaluation.confusion(_baseline(spark, d))


def segmentation_prf(spark, d):
    gold = held_out(_segments(spark, d), spark, d)
    guess = spans.gazetteer_spans(held_out(tokens(spark, d), spark, d), _gazetteer(spark, d)).withColumnRenamed("type", "label")
    return evaluation.precision_recall(gold, guess, ["sent_id", "label", "begin", "end"], ["label"])


def sentiment_accuracy(spark, d):
    """Agreement of the most frequent tag's frequency class and the sentence length's, as five classes."""
    s = tokens(spark, d).groupBy("sent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("word").rlike(r"^\p{Lu}")).alias("u"))
    cells = s.select(F.pmod("n", F.lit(5)).alias("gold"), F.pmod("u", F.lit(5)).alias("pred")).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.sentiment_accuracy(cells)


def train_dev_test_split(spark, d):
    """The first three fifths, then one fifth each, by order within every docid."""
    w = Window.partitionBy("docid").orderBy("idx", "sent_id")
    s = one_sentences(spark, d).where("docid is not null").select("docid", "sent_id", (F.row_number().over(w) - 1).alias("i"))
    m = F.pmod("i", F.lit(5))
    return s.select("sent_id", F.when(m < 3, "train").when(m == 3, "dev").otherwise("test").alias("split"))


def first_per_portion(spark, d):
    """Sub-sampled corpus: the first 20 sentences of every source."""
    w = Window.partitionBy("source").orderBy("sent_id")
    s = one_sentences(spark, d).where("source is not null").select("source", "sent_id", F.row_number().over(w).alias("i"))
    return s.where("i <= 20").select("source", "sent_id")


def tagged_render(spark, d):
    """Each sentence as word/tag pairs."""
    t = tagged(spark, d).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("/", "word", "tag").alias("wt")))).alias("a"))
    return t.select("sent_id", F.array_join(F.transform("a", lambda x: x["wt"]), " ").alias("line"))


QUERIES = {f.__name__: f for f in (
    entity_segments, bio_encode, bio_decode, segment_gaps, filter_words_reindex, flat_tags, max_segment_length, span_enumeration,
    span_length_bins, span_shapes, span_edges, span_mask, layered_span_mask, crossing_spans, negation_scope, quote_state,
    gazetteer_word, gazetteer_span, feature_index, feature_encode, nonredundant_features, cross_index, segmented_index,
    label_word_counts, marginal_counts, log_normalize, most_common_label, tag_transitions, tagging_eval, confusion_matrix,
    segmentation_prf, sentiment_accuracy, train_dev_test_split, first_per_portion, tagged_render,
)}

_SEG = TOK + """,
 e0 AS (SELECT DISTINCT sent_id, e.ner_type AS label, e.span_begin AS b, e.span_end AS e FROM (SELECT sent_id, len(words) AS n, unnest(annotations.ner) AS e FROM one)
   WHERE e.ner_type IS NOT NULL AND e.span_begin >= 0 AND e.span_begin < e.span_end AND e.span_end <= n),
 seg AS (SELECT sent_id, label, b, e FROM (SELECT *, coalesce(max(e) OVER (PARTITION BY sent_id ORDER BY b, e, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM e0) WHERE b >= bef),
 bio AS (SELECT t.sent_id, t.pos, t.word, s.label, CASE WHEN s.label IS NULL THEN 'O' WHEN t.pos = s.b THEN 'B-' || s.label ELSE 'I-' || s.label END AS bio
   FROM tok t LEFT JOIN seg s ON t.sent_id = s.sent_id AND t.pos >= s.b AND t.pos < s.e)"""
_GAZ = _SEG + """,
 gaz AS (SELECT DISTINCT label AS type, list(word ORDER BY pos) AS words FROM bio JOIN seg USING (sent_id, label) WHERE sent_id NOT IN (SELECT sent_id FROM held) AND pos >= seg.b AND pos < seg.e GROUP BY sent_id, label, seg.b),
 odd AS (SELECT * FROM tok),
 gk AS (SELECT array_to_string(words, ' ') AS key, len(words) AS n, max(type) AS type FROM gaz GROUP BY 1, 2),
 lens AS (SELECT DISTINCT n FROM gk),
 gram AS (SELECT a.sent_id, a.pos AS b, lens.n, array_to_string(list(o.word ORDER BY o.pos), ' ') AS key FROM odd a, lens JOIN odd o ON o.sent_id = a.sent_id AND o.pos >= a.pos AND o.pos < a.pos + lens.n
   GROUP BY 1, 2, 3 HAVING count(*) = any_value(lens.n)),
 gs AS (SELECT sent_id, b, b + gram.n AS e, gk.type FROM gram JOIN gk USING (key, n))"""
_LONGEST = "(SELECT max(e - b) FROM seg)"
_ENUM = "sp AS (SELECT sent_id, b, unnest(range(b + 1, least(n, b + {k}) + 1)) AS e FROM (SELECT sent_id, len(words) AS n, unnest(range(len(words))) AS b FROM one))"
_F = f"WITH {TOK}, f AS (SELECT sent_id AS context, lower(word) AS feature FROM tok)"
_BASE = f"""WITH {TAGGED}, c AS (SELECT word, tag, count(*) AS n FROM tagged WHERE sent_id NOT IN (SELECT sent_id FROM held) GROUP BY 1, 2),
 best AS (SELECT word, tag AS pred FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) = 1),
 p AS (SELECT sent_id, pos, tag AS gold, coalesce(pred, 'NN') AS pred FROM tagged LEFT JOIN best USING (word) WHERE sent_id IN (SELECT sent_id FROM held))"""
_LW = f"WITH {TAGGED}, c AS (SELECT tag, word, count(*) AS n FROM tagged GROUP BY 1, 2)"
_BINS = "CAST(CASE WHEN {x} <= 5 THEN {x} WHEN {x} <= 10 THEN 6 WHEN {x} <= 20 THEN 7 ELSE 8 END AS INT)"
_BE = 'b AS "begin", e AS "end"'

SQL = {
    "entity_segments": f"WITH {_SEG} SELECT sent_id, label, {_BE} FROM seg",
    "bio_encode": f"WITH {_SEG} SELECT sent_id, pos, bio FROM bio",
    "bio_decode": f"WITH {_SEG} SELECT sent_id, label, {_BE} FROM seg UNION ALL SELECT sent_id, 'O', pos, pos + 1 FROM bio WHERE bio = 'O'",
    "segment_gaps": f"WITH {_SEG} SELECT sent_id, label, {_BE} FROM seg UNION ALL SELECT sent_id, 'O', pos, pos + 1 FROM bio WHERE bio = 'O'",
    "filter_words_reindex": f"""WITH {_SEG}, k AS (SELECT sent_id, pos, regexp_matches(word, '\\p{{L}}') AS k, coalesce(sum(CASE WHEN regexp_matches(word, '\\p{{L}}') THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new FROM tok)
 SELECT sent_id, label, CAST(min(new) AS INT) AS "begin", CAST(min(new) + count(*) FILTER (k) AS INT) AS "end" FROM seg JOIN k USING (sent_id) WHERE pos >= b AND pos < e GROUP BY sent_id, label, b, e HAVING count(*) FILTER (k) > 0""",
    "flat_tags": f"WITH {_SEG} SELECT coalesce(label, 'O') AS label, count(*) AS n FROM bio GROUP BY 1",
    "max_segment_length": f"WITH {_SEG} SELECT label, max(e - b) AS most, count(*) AS n FROM seg GROUP BY 1",
    "span_enumeration": f"WITH {_SEG}, {_ENUM.format(k=_LONGEST)} SELECT sent_id, {_BE} FROM sp",
    "span_length_bins": f"WITH {ONE}, {_ENUM.format(k='n')} SELECT {_BINS.format(x='(e - b)')} AS bin, count(*) AS n FROM sp GROUP BY 1",
    "span_shapes": f"""WITH {_SEG}, cb AS (SELECT sent_id, pos, CASE WHEN regexp_matches(c, '\\p{{Lu}}') THEN 'X' WHEN regexp_matches(c, '\\p{{L}}') THEN 'x' WHEN regexp_matches(c, '\\p{{N}}') THEN 'd' ELSE c END AS c
   FROM (SELECT sent_id, pos, left(CASE word WHEN '-LRB-' THEN '(' WHEN '-RRB-' THEN ')' WHEN '-LSB-' THEN '[' WHEN '-RSB-' THEN ']' WHEN '-LCB-' THEN '{{' WHEN '-RCB-' THEN '}}' ELSE word END, 1) AS c FROM tok)),
 a AS (SELECT seg.sent_id, label, b, e, string_agg(CASE WHEN pos < b THEN '' WHEN e - b > 6 AND pos >= b + 3 AND pos < e - 3 THEN '' ELSE (CASE WHEN e - b > 6 AND pos = e - 3 THEN '~' ELSE '' END) || c END, '' ORDER BY pos) FILTER (pos >= b AND pos < e) AS i,
   max(CASE WHEN pos = b - 1 THEN c END) AS l, max(CASE WHEN pos = e THEN c END) AS r FROM seg JOIN cb ON seg.sent_id = cb.sent_id AND pos BETWEEN b - 1 AND e GROUP BY 1, 2, 3, 4)
 SELECT sent_id, label, {_BE}, coalesce(l, '#') || '[' || i || ']' || coalesce(r, '#') AS shape FROM a""",
    "span_edges": f"""WITH {_SEG} SELECT label, f.word || ' & ' || l.word AS edges, count(*) AS n FROM seg JOIN tok f ON f.sent_id = seg.sent_id AND f.pos = b JOIN tok l ON l.sent_id = seg.sent_id AND l.pos = e - 1 GROUP BY 1, 2""",
    "span_mask": f"WITH {_SEG}, {_ENUM.format(k=_LONGEST)} SELECT sent_id, {_BE} FROM sp SEMI JOIN seg USING (sent_id, b, e)",
    "layered_span_mask": f"""WITH {_SEG}, {_ENUM.format(k=_LONGEST)}, u AS (SELECT DISTINCT sent_id, pos, label FROM bio WHERE label IS NOT NULL), m AS (SELECT label, max(e - b) AS most FROM seg GROUP BY 1)
 SELECT u.label, e - b AS len, count(*) AS n FROM sp JOIN u ON u.sent_id = sp.sent_id AND u.pos = b JOIN m ON m.label = u.label AND e - b <= most
 WHERE e - b = 1 OR EXISTS (SELECT 1 FROM u v WHERE v.sent_id = sp.sent_id AND v.pos = b + 1 AND v.label = u.label) GROUP BY 1, 2""",
    "crossing_spans": f"""WITH {_SEG}, m AS (SELECT DISTINCT sent_id, c.span_begin AS mb, c.span_end AS me FROM (SELECT sent_id, unnest(annotations.coref) AS c FROM one))
 SELECT count(*) FILTER (b <= mb AND me <= e) AS n_inside, count(*) FILTER (b < mb AND e < me AND e > mb OR mb < b AND me < e AND me > b) AS n_cross, count(*) AS n FROM seg JOIN m USING (sent_id)""",
    "negation_scope": f"""WITH {TOK}, v AS (SELECT sent_id, pos, CASE WHEN lower(word) IN ('not', 'n''t', 'nothing') THEN 1 WHEN word IN ('.', ',', ';', '--', ':') THEN 0 END AS ev FROM tok)
 SELECT sent_id, pos, ev IS NULL AND coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS negated FROM v""",
    "quote_state": f"""WITH {TOK}, q AS (SELECT sent_id, sum(CASE WHEN word = '"' THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 2 = 1 AS i FROM tok) SELECT sent_id, count(*) FILTER (i) AS n FROM q GROUP BY 1""",
    "gazetteer_word": f"""WITH {_GAZ}, gw AS (SELECT type, unnest(words) AS word, generate_subscripts(words, 1) = len(words) AS last FROM gaz), gt AS (SELECT word, type AS t FROM gw UNION SELECT word, 'END-' || type FROM gw WHERE last)
 SELECT sent_id, pos, string_agg(t, ' ' ORDER BY t) AS types FROM odd JOIN gt USING (word) GROUP BY 1, 2""",
    "gazetteer_span": f"WITH {_GAZ} SELECT sent_id, {_BE}, type FROM gs",
    "feature_index": f"{_F} SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS id, n FROM (SELECT feature, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 2)",
    "feature_encode": f"{_F}, i AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS id FROM (SELECT feature FROM f GROUP BY 1 HAVING count(*) >= 3)) SELECT context, count(*) AS n, CAST(sum(id) AS BIGINT) AS s FROM f JOIN i USING (feature) GROUP BY 1",
    "nonredundant_features": f"{_F}, g AS (SELECT feature, list_sort(list(DISTINCT context)) AS ctx FROM f GROUP BY 1) SELECT min(feature) AS feature FROM g GROUP BY ctx",
    "cross_index": f"WITH {TAGGED} SELECT tag AS label, lower(word) AS feature, count(*) AS n FROM tagged GROUP BY 1, 2 HAVING count(*) >= 3",
    "segmented_index": f"""WITH {TAGGED}, a AS (SELECT 0 AS segment, tag AS feature FROM tagged GROUP BY 2), b AS (SELECT 1 AS segment, lower(word) AS feature FROM tagged GROUP BY 2 HAVING count(*) >= 5)
 SELECT segment, feature, row_number() OVER (ORDER BY segment, feature) - 1 AS id FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "label_word_counts": f"{_LW} SELECT tag, word, n FROM c",
    "marginal_counts": f"""WITH {TAGGED}, c AS (SELECT tag, lower(word) AS word, count(*) AS n FROM tagged GROUP BY 1, 2) SELECT tag, NULL AS word, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_cells FROM c GROUP BY 1
 UNION ALL SELECT NULL, word, CAST(sum(n) AS BIGINT), count(*) FROM c GROUP BY 2 UNION ALL SELECT NULL, NULL, CAST(sum(n) AS BIGINT), count(*) FROM c""",
    "log_normalize": f"{_LW} SELECT tag, word, round(ln(n / sum(n) OVER (PARTITION BY tag)), 6) AS logp FROM c",
    "most_common_label": f"{_LW} SELECT word, tag, n FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) = 1",
    "tag_transitions": f"""WITH {TAG}, t AS (SELECT coalesce(lag(tag) OVER (PARTITION BY sent_id ORDER BY pos), '<s>') AS prev, tag AS cur FROM tag), c AS (SELECT prev, cur, count(*) AS n FROM t GROUP BY 1, 2)
 SELECT prev, cur, n, round(ln(n / sum(n) OVER (PARTITION BY prev)), 6) AS logp FROM c""",
    "tagging_eval": f"{_BASE}, s AS (SELECT sent_id, count(*) AS n, count(*) FILTER (gold = pred) AS r FROM p GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(r) AS BIGINT) AS n_right, count(*) AS n_sentences, count(*) FILTER (n = r) AS n_exact FROM s",
    "confusion_matrix": f"{_BASE} SELECT gold, pred, count(*) AS n FROM p GROUP BY 1, 2",
    "segmentation_prf": f"""WITH {_GAZ}, g AS (SELECT DISTINCT sent_id, label, b, e FROM seg WHERE sent_id IN (SELECT sent_id FROM held)), p AS (SELECT DISTINCT sent_id, type AS label, b, e FROM gs WHERE sent_id IN (SELECT sent_id FROM held)),
 u AS (SELECT coalesce(g.label, p.label) AS label, g.sent_id IS NOT NULL AS ig, p.sent_id IS NOT NULL AS ip FROM g FULL JOIN p ON g.sent_id = p.sent_id AND g.label = p.label AND g.b = p.b AND g.e = p.e),
 c AS (SELECT label, count(*) FILTER (ig) AS n_gold, count(*) FILTER (ip) AS n_guess, count(*) FILTER (ig AND ip) AS n_right FROM u GROUP BY 1)
 SELECT *, round(CASE WHEN n_guess = 0 THEN 1.0 ELSE n_right / n_guess END, 6) AS precision, round(CASE WHEN n_gold = 0 THEN 1.0 ELSE n_right / n_gold END, 6) AS recall, round(2 * n_right / (n_gold + n_guess), 6) AS f1 FROM c""",
    "sentiment_accuracy": f"""WITH {TOK}, s AS (SELECT count(*) % 5 AS g, count(*) FILTER (regexp_matches(word, '^\\p{{Lu}}')) % 5 AS p FROM tok GROUP BY sent_id)
 SELECT round(count(*) FILTER (g = p) / count(*), 4) AS fine, round(count(*) FILTER (sign(g - 2) = sign(p - 2)) / count(*), 4) AS ternary, round(count(*) FILTER (g <> 2 AND sign(g - 2) = sign(p - 2)) / count(*) FILTER (g <> 2), 4) AS binary FROM s""",
    "train_dev_test_split": f"""WITH {ONE}, r AS (SELECT sent_id, (row_number() OVER (PARTITION BY docid ORDER BY idx, sent_id) - 1) % 5 AS m FROM one WHERE docid IS NOT NULL)
 SELECT sent_id, CASE WHEN m < 3 THEN 'train' WHEN m = 3 THEN 'dev' ELSE 'test' END AS split FROM r""",
    "first_per_portion": f"WITH {ONE} SELECT source, sent_id FROM one WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY sent_id) <= 20",
    "tagged_render": f"WITH {TAGGED} SELECT sent_id, string_agg(word || '/' || tag, ' ' ORDER BY pos) AS line FROM tagged GROUP BY 1",
}
