"""Word functions and word featurizers over the sentences' tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.functions import maths
from lexiframe.functions import words as W
from lexiframe.operators import wordfeats as wf
from lexiframe.plans.common import TAGGED, TOK, tagged, tokens, training
from lexiframe.session import table


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).select("word").distinct()


def word_counts(spark, d):
    return wf.word_counts(tokens(spark, d))


def word_shapes(spark, d):
    return _vocabulary(spark, d).select("word", W.shape(F.col("word")).alias("shape"))


def word_class_signature(spark, d):
    return _vocabulary(spark, d).select("word", W.word_class(F.col("word")).alias("sig"))


def word_properties(spark, d):
    return _vocabulary(spark, d).select("word", F.array_join(W.properties(F.col("word")), ",").alias("props"))


def digit_normalize(spark, d):
    return _vocabulary(spark, d).select("word", W.digits_to_zero(F.col("word")).alias("zeroed"))


def prefix_features(spark, d):
    return _vocabulary(spark, d).select("word", F.explode(W.prefixes(F.col("word"), 4)).alias("prefix"))


def suffix_features(spark, d):
    return _vocabulary(spark, d).select("word", F.explode(W.suffixes(F.col("word"), 4)).alias("suffix"))


def suffix_counts(spark, d):
    return wf.suffix_mass(tokens(spark, d))


def longest_frequent_suffix(spark, d):
    return wf.longest_frequent_suffix(tokens(spark, d))


def buckwalter_translate(spark, d):
    return _vocabulary(spark, d).select("word", W.buckwalter_to_arabic(F.col("word")).alias("arabic"))


def vector_keys(spark, d):
    return _vocabulary(spark, d).select("word", W.vector_key(F.col("word"), True).alias("k"))


def distance_bins(spark, d):
    r = spark.range(-30, 31).select(F.col("id").cast("int").alias("d"))
    return r.select("d", maths.distance_bin(F.col("d")).alias("bin"), maths.binned_distance(F.col("d")).alias("binned"))


def activations(spark, d):
    x = F.col("x")
    r = table(spark, d, "word_vectors").where("vec is not null").select("vec_id", F.posexplode("vec").alias("i", "x")).where(~F.isnan("x"))
    r = r.select("vec_id", "i", F.col("x").cast("double").alias("x"))
    return r.groupBy("vec_id").agg(*[F.round(F.sum(f), 6).alias(n) for n, f in (("relu", maths.relu(x)), ("requ", maths.requ(x)), ("cube", maths.cube(x)), ("tanh", F.tanh(x)), ("sigmoid", maths.sigmoid(x)))])


def log_sums(spark, d):
    r = table(spark, d, "word_vectors").where("vec is not null").select("vec_id", F.filter("vec", lambda x: ~F.isnan(x)).cast("array<double>").alias("v"))
    return r.where(F.size("v") > 0).select("vec_id", F.round(maths.log_sum_array(F.col("v")), 6).alias("s"), F.array_max("v").alias("m"))


def word_identity_unk(spark, d):
    t = wf.with_counts(tokens(spark, d))
    return t.select("sent_id", "pos", wf.identity(F.col("word"), F.col("n")).alias("feat"))


def shape_or_word(spark, d):
    t = wf.with_counts(tokens(spark, d))
    return t.groupBy(wf.shape_or_word(F.col("word"), F.col("n")).alias("feat")).agg(F.count(F.lit(1)).alias("k"))


def class_or_word(spark, d):
    t = wf.with_counts(tokens(spark, d))
    return t.groupBy(wf.class_or_word(F.col("word"), F.col("n")).alias("feat")).agg(F.count(F.lit(1)).alias("k"))


def minimal_features(spark, d):
    t = wf.with_counts(tokens(spark, d))
    return t.select(F.explode(wf.minimal(F.col("word"), F.col("n"))).alias("feat")).groupBy("feat").agg(F.count(F.lit(1)).alias("k"))


def affix_features(spark, d):
    t = wf.with_counts(tokens(spark, d))
    return t.select(F.explode(wf.affixes(F.col("word"), F.col("n"))).alias("feat")).groupBy("feat").agg(F.count(F.lit(1)).alias("k"))


def cross_product_features(spark, d):
    t = tokens(spark, d)
    a = F.array(W.shape(F.col("word")), W.word_class(F.col("word")))
    b = F.array(F.lower("word"))
    return t.select(F.explode(wf.cross(a, b)).alias("feat")).groupBy("feat").agg(F.count(F.lit(1)).alias("k"))


def offset_features(spark, d):
    t = tokens(spark, d).withColumn("f", F.array("word"))
    return t.select("sent_id", "pos", F.array_join(wf.offset(F.col("f"), -1), " ").alias("before"), F.array_join(wf.offset(F.col("f"), 2), " ").alias("after"))


def context_window(spark, d):
    return tokens(spark, d).select("sent_id", "pos", F.array_join(wf.context_set(F.col("word"), 2), " ").alias("ctx"))


def context_bigrams(spark, d):
    t = tokens(spark, d).select(wf.context_words(F.col("word")).alias("f"))
    return t.select(F.explode("f").alias("feat")).groupBy("feat").agg(F.count(F.lit(1)).alias("k"))


def next_actual_word(spark, d):
    w = F.col("word")
    return tokens(spark, d).select("sent_id", "pos", wf.next_actual(w).alias("nxt"), wf.previous_actual(w).alias("prv"))


def position_caps(spark, d):
    return tokens(spark, d).select("sent_id", "pos", wf.position_caps(F.col("word")).alias("caps"))


def sentence_properties(spark, d):
    p = wf.sentence_properties(tokens(spark, d))
    return p.select("sent_id", "n", maths.distance_bin(F.col("n").cast("int")).alias("bin"), "all_upper")


def bigram_counts(spark, d):
    t = tokens(spark, d).select(wf.ngrams(F.col("word"), 2).alias("gram"))
    return t.where("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def ngram_counts(spark, d):
    t = tokens(spark, d)
    grams = [t.select(F.lit(n).alias("size"), wf.ngrams(F.col("word"), n).alias("gram")) for n in (3, 4)]
    return grams[0].unionByName(grams[1]).where("gram is not null").groupBy("size", "gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def tag_dictionary(spark, d):
    return wf.tag_dictionary(tagged(spark, d))


def open_class_tags(spark, d):
    return wf.open_tags(tagged(spark, d)).select("word", F.array_join("tags", " ").alias("tags"))


def signature_lexicon(spark, d):
    return wf.signature_lexicon(tagged(spark, d)).select("key", F.array_join("tags", " ").alias("tags"))


def backoff_lookup(spark, d):
    """Tags of every word of the sentences."""
    lex = wf.signature_lexicon(training(tagged(spark, d), spark, d))
    return wf.backoff_lookup(_vocabulary(spark, d), lex, F.array(F.lit("*"))).select("word", F.array_join("tags", " ").alias("tags"))


QUERIES = {f.__name__: f for f in (
    word_counts, word_shapes, word_class_signature, word_properties, digit_normalize, prefix_features, suffix_features,
    suffix_counts, longest_frequent_suffix, buckwalter_translate, vector_keys, distance_bins, activations, log_sums,
    word_identity_unk, shape_or_word, class_or_word, minimal_features, affix_features, cross_product_features,
    offset_features, context_window, context_bigrams, next_actual_word, position_caps, sentence_properties,
    bigram_counts, ngram_counts, tag_dictionary, open_class_tags, signature_lexicon, backoff_lookup,
)}

_V = f"WITH {TOK}, v AS (SELECT DISTINCT word FROM tok)"
_C = f"WITH {TOK}, c AS (SELECT word, count(*) AS n FROM tok GROUP BY 1)"
_CT = _C + ", ct AS (SELECT * FROM tok JOIN c USING (word))"


def _shape(w: str) -> str:
    s = f"regexp_replace(regexp_replace(regexp_replace({w}, '\\p{{Lu}}', 'X', 'g'), '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]', 'x', 'g'), '\\p{{Nd}}', 'd', 'g')"
    for c in "Xxd":
        s = f"regexp_replace({s}, '{c}{{3,}}', '{c}{c}e', 'g')"
    return s


def _class(w: str) -> str:
    caps = f"length(regexp_replace({w}, '[^\\p{{Lu}}\\p{{Lt}}]', '', 'g'))"
    digit, dash = f"regexp_matches({w}, '\\p{{Nd}}')", f"contains({w}, '-')"
    case = (
        f"CASE WHEN regexp_matches({w}, '^[\\p{{Lu}}\\p{{Lt}}]') AND {caps} = 1 THEN '-INITC' WHEN regexp_matches({w}, '^[\\p{{Lu}}\\p{{Lt}}]') THEN '-CAPS' "
        f"WHEN NOT regexp_matches({w}, '^\\p{{L}}') AND {caps} > 0 THEN '-CAPS' WHEN length({w}) > {caps} THEN '-LC' ELSE '' END"
    )
    tails = " ".join(f"WHEN lower({w}) LIKE '%{s}' THEN '-{s}'" for s in W.CLASS_SUFFIXES)
    suffix = (
        f"CASE WHEN lower({w}) LIKE '%s' AND length(lower({w})) >= 3 THEN CASE WHEN regexp_matches(lower({w}), '[siu]s$') THEN '' ELSE '-s' END "
        f"WHEN length(lower({w})) >= 5 AND NOT {dash} AND NOT ({digit} AND {caps} > 0) THEN CASE {tails} ELSE '' END ELSE '' END"
    )
    return f"({case} || CASE WHEN {digit} THEN '-NUM' ELSE '' END || CASE WHEN {dash} THEN '-DASH' ELSE '' END || {suffix})"


_PROPS = {
    "AllCaps": "caps >= 2 AND NOT regexp_matches(word, '\\p{Ll}') AND NOT regexp_matches(word, '[^\\p{L}]')",
    "Dash": "contains(word, '-')", "Digit": "regexp_matches(word, '\\p{Nd}')", "EndsWithPeriod": "word LIKE '%.'", "EndsWithS": "word LIKE '%s'",
    "Float": "regexp_full_match(word, '[0-9]*\\.[0-9]+')", "HasCap": "caps > 0", "InitCap": "regexp_matches(word, '^\\p{Lu}')",
    "InitCapS": "regexp_matches(word, '^\\p{Lu}') AND word LIKE '%s'", "Initial": "regexp_full_match(word, '\\p{Lu}\\.')", "Integer": "regexp_full_match(word, '[0-9]+')",
    "Long": "length(word) > 10", "ManyCap": "caps > 1", "NoLetter": "NOT regexp_matches(word, '\\p{L}')", "NoLower": "NOT regexp_matches(word, '\\p{Ll}')",
    "NotLetter": "regexp_matches(word, '[^\\p{L}]')",
    "ProbablyAcronym": "caps >= 2 AND NOT regexp_matches(word, '\\p{Ll}') AND NOT regexp_matches(word, '[^\\p{L}]') AND length(word) BETWEEN 3 AND 5 "
    "OR contains(word, '.') AND NOT regexp_matches(word, '\\p{Ll}') AND caps >= 1 AND NOT regexp_matches(word, '[^\\p{L}.]') AND length(word) >= 2",
    "ProbablyYear": "CASE WHEN regexp_full_match(word, '[0-9]{4}') THEN CAST(word AS INT) BETWEEN 1400 AND 2299 ELSE false END", "Short": "length(word) < 5",
}
_TAILS = "(SELECT word, n, substring(word, i + 1) AS suffix FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM c WHERE n <= 5))"
_MASS = f"SELECT suffix, CAST(sum(n) AS BIGINT) AS mass FROM {_TAILS} GROUP BY 1 HAVING sum(n) >= 20"
_WIN = "OVER (PARTITION BY sent_id ORDER BY pos"
_ACT = "CASE WHEN regexp_matches(word, '[\\p{L}\\p{N}]') THEN word END"
_LEX = f"""lex AS (SELECT CASE WHEN n >= 5 THEN word ELSE {_class('word')} END AS key, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags FROM src JOIN cnt USING (word) GROUP BY 1)"""

SQL = {
    "word_counts": f"WITH {TOK} SELECT word, count(*) AS n FROM tok GROUP BY 1",
    "word_shapes": f"{_V} SELECT word, {_shape('word')} AS shape FROM v",
    "word_class_signature": f"{_V} SELECT word, {_class('word')} AS sig FROM v",
    "word_properties": f"{_V}, k AS (SELECT word, length(regexp_replace(word, '[^\\p{{Lu}}]', '', 'g')) AS caps FROM v) SELECT word, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _PROPS.items()) + ") AS props FROM k",
    "digit_normalize": f"{_V} SELECT word, regexp_replace(word, '\\p{{Nd}}', '0', 'g') AS zeroed FROM v",
    "prefix_features": f"{_V} SELECT word, left(word, i) AS prefix FROM (SELECT word, unnest(range(1, least(length(word) - 1, 4) + 1)) AS i FROM v WHERE length(word) >= 4)",
    "suffix_features": f"{_V} SELECT word, right(word, i) AS suffix FROM (SELECT word, unnest(range(1, least(length(word) - 1, 4) + 1)) AS i FROM v WHERE length(word) >= 5)",
    "suffix_counts": f"{_C} {_MASS}",
    "longest_frequent_suffix": f"""{_C}, m AS ({_MASS}), b AS (SELECT word, max_by(suffix, CASE WHEN mass IS NOT NULL THEN length(suffix) END) AS suffix FROM {_TAILS} LEFT JOIN m USING (suffix) GROUP BY 1)
 SELECT word, word AS suffix FROM c WHERE n > 5 UNION ALL SELECT word, coalesce(suffix, '-UNK-') FROM b""",
    "buckwalter_translate": f"{_V} SELECT word, CASE WHEN word IN ('-LRB-', '-RRB-', '-LSB-', '-RSB-', '-LCB-', '-RCB-') THEN word ELSE translate(word, '{W.BUCKWALTER.replace(chr(39), chr(39) * 2)}', '{W.ARABIC}') END AS arabic FROM v",
    "vector_keys": f"""{_V}, u AS (SELECT word, CASE word WHEN '-LRB-' THEN '(' WHEN '-RRB-' THEN ')' WHEN '-LSB-' THEN '[' WHEN '-RSB-' THEN ']' WHEN '-LCB-' THEN '{{' WHEN '-RCB-' THEN '}}' ELSE word END AS x FROM v)
 SELECT word, lower(CASE WHEN regexp_full_match(x, '[0-9]{{5,}}') THEN 'fifteen' WHEN regexp_full_match(x, '.+-[^-]+') THEN regexp_extract(word, '^(.+)-([^-]+)$', 2) ELSE x END) AS k FROM u""",
    "distance_bins": """WITH r AS (SELECT CAST(unnest(range(-30, 31)) AS INT) AS d),
 b AS (SELECT d, CASE WHEN abs(d) <= 5 THEN greatest(abs(d), 1) WHEN abs(d) <= 10 THEN 6 WHEN abs(d) <= 20 THEN 7 ELSE 8 END AS k FROM r)
 SELECT d, CAST(sign(d) * k AS INT) AS bin, CAST(CASE WHEN d = 0 THEN 0 WHEN d > 10 THEN 21 WHEN d > 5 THEN 10 WHEN d > 0 THEN d WHEN d >= -5 THEN d WHEN d >= -10 THEN -10 WHEN d >= -20 THEN -20 ELSE -21 END AS INT) AS binned FROM b""",
    "activations": """WITH e AS (SELECT vec_id, CAST(unnest(vec) AS DOUBLE) AS x FROM word_vectors WHERE vec IS NOT NULL)
 SELECT vec_id, round(sum(greatest(x, 0.0)), 6) AS relu, round(sum(CASE WHEN x > 0 THEN x * x ELSE 0 END), 6) AS requ, round(sum(x * x * x), 6) AS cube, round(sum(tanh(x)), 6) AS tanh, round(sum(1 / (1 + exp(-x))), 6) AS sigmoid FROM e WHERE NOT isnan(x) AND x IS NOT NULL GROUP BY 1""",
    "log_sums": """WITH e AS (SELECT vec_id, CAST(unnest(vec) AS DOUBLE) AS x FROM word_vectors WHERE vec IS NOT NULL), f AS (SELECT * FROM e WHERE NOT isnan(x)), m AS (SELECT vec_id, max(x) AS m FROM f GROUP BY 1)
 SELECT vec_id, round(any_value(m) + ln(sum(exp(x - m))), 6) AS s, any_value(m) AS m FROM f JOIN m USING (vec_id) GROUP BY 1""",
    "word_identity_unk": f"{_CT} SELECT sent_id, pos, CASE WHEN n > 2 THEN word ELSE '#UNK#' END AS feat FROM ct",
    "shape_or_word": f"{_CT} SELECT CASE WHEN n > 100 THEN word ELSE {_shape('word')} END AS feat, count(*) AS k FROM ct GROUP BY 1",
    "class_or_word": f"{_CT} SELECT CASE WHEN n > 100 THEN word ELSE {_class('word')} END AS feat, count(*) AS k FROM ct GROUP BY 1",
    "minimal_features": f"""{_CT}, f AS (SELECT unnest([CASE WHEN n > 2 THEN 'Word(' || word || ')' END, 'Class(' || {_class('word')} || ')', CASE WHEN n <= 5 THEN 'Shape(' || {_shape('word')} || ')' END, CASE WHEN n <= 2 THEN 'Unk' END]) AS feat FROM ct)
 SELECT feat, count(*) AS k FROM f WHERE feat IS NOT NULL GROUP BY 1""",
    "affix_features": f"""{_CT}, p AS (SELECT word, unnest(range(1, least(length(word) - 1, 4) + 1)) AS i FROM ct WHERE n <= 100)
 SELECT feat, count(*) AS k FROM (SELECT 'Prefix(' || left(word, i) || ')' AS feat FROM p WHERE length(word) >= 4 UNION ALL SELECT 'Suffix(' || right(word, i) || ')' FROM p WHERE length(word) >= 5) GROUP BY 1""",
    "cross_product_features": f"WITH {TOK}, f AS (SELECT unnest([{_shape('word')}, {_class('word')}]) AS a, lower(word) AS b FROM tok) SELECT a || ' & ' || b AS feat, count(*) AS k FROM f GROUP BY 1",
    "offset_features": f"WITH {TOK} SELECT sent_id, pos, coalesce(lag(word) {_WIN}), 'Boundary') AS before, coalesce(lead(word, 2) {_WIN}), 'Boundary') AS after FROM tok",
    "context_window": f"""WITH {TOK}, p AS (SELECT a.sent_id, a.pos, b.word FROM tok a LEFT JOIN tok b ON a.sent_id = b.sent_id AND b.pos <> a.pos AND b.pos BETWEEN a.pos - 2 AND a.pos + 2)
 SELECT sent_id, pos, coalesce(array_to_string(list_sort(list(DISTINCT word) FILTER (word IS NOT NULL)), ' '), '') AS ctx FROM p GROUP BY 1, 2""",
    "context_bigrams": f"""WITH {TOK}, w AS (SELECT word, coalesce(lag(word) {_WIN}), '<s>') AS p, coalesce(lead(word) {_WIN}), '</s>') AS x FROM tok)
 SELECT feat, count(*) AS k FROM (SELECT unnest(['L:' || p, 'R:' || x, p || '_' || word, word || '_' || x]) AS feat FROM w) GROUP BY 1""",
    "next_actual_word": f"""WITH {TOK} SELECT sent_id, pos, first_value({_ACT} IGNORE NULLS) {_WIN} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
 last_value({_ACT} IGNORE NULLS) {_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prv FROM tok""",
    "position_caps": f"""WITH {TOK} SELECT sent_id, pos, CASE WHEN regexp_matches(word, '^\\p{{Lu}}') THEN CASE WHEN pos = 0 OR coalesce(lag(word) {_WIN}), '') = '``' THEN 'FirstCap' ELSE 'InnerCap' END ELSE 'NoCap' END AS caps FROM tok""",
    "sentence_properties": f"""WITH {TOK}, s AS (SELECT sent_id, count(*) AS n, bool_and(NOT regexp_matches(word, '\\p{{Ll}}')) AS all_upper FROM tok GROUP BY 1)
 SELECT sent_id, n, CAST(CASE WHEN n <= 5 THEN n WHEN n <= 10 THEN 6 WHEN n <= 20 THEN 7 ELSE 8 END AS INT) AS bin, all_upper FROM s""",
    "bigram_counts": f"WITH {TOK}, w AS (SELECT word, lead(word) {_WIN}) AS x FROM tok) SELECT word || ' ' || x AS gram, count(*) AS n FROM w WHERE x IS NOT NULL GROUP BY 1",
    "ngram_counts": f"""WITH {TOK}, w AS (SELECT word, lead(word) {_WIN}) AS b, lead(word, 2) {_WIN}) AS c, lead(word, 3) {_WIN}) AS d FROM tok)
 SELECT 3 AS size, word || ' ' || b || ' ' || c AS gram, count(*) AS n FROM w WHERE c IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1
 UNION ALL SELECT 4, word || ' ' || b || ' ' || c || ' ' || d, count(*) FROM w WHERE d IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""",
    "tag_dictionary": f"""WITH {TAGGED} SELECT word, any_value(tag) AS tag FROM tagged GROUP BY 1 HAVING count(DISTINCT tag) = 1 AND count(*) > 2 AND count(*) < 10000""",
    "open_class_tags": f"""WITH {TAGGED}, op AS (SELECT tag FROM tagged GROUP BY 1 HAVING count(DISTINCT word) > 50), w AS (SELECT word, count(*) AS n FROM tagged GROUP BY 1),
 a AS (SELECT DISTINCT word, tag FROM tagged UNION SELECT w.word, op.tag FROM w, op WHERE w.n < 10) SELECT word, string_agg(tag, ' ' ORDER BY tag) AS tags FROM a GROUP BY 1""",
    "signature_lexicon": f"WITH {TAGGED}, src AS (SELECT * FROM tagged), cnt AS (SELECT word, count(*) AS n FROM tagged GROUP BY 1), {_LEX} SELECT key, tags FROM lex",
    "backoff_lookup": f"""WITH {TAGGED}, src AS (SELECT * FROM tagged WHERE sent_id NOT IN (SELECT sent_id FROM held)), cnt AS (SELECT word, count(*) AS n FROM src GROUP BY 1), {_LEX},
 w AS (SELECT DISTINCT word FROM tok) SELECT w.word, coalesce(a.tags, b.tags, '*') AS tags FROM w LEFT JOIN lex a ON w.word = a.key LEFT JOIN lex b ON {_class('w.word')} = b.key""",
}
