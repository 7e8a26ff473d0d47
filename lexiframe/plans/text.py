"""Segmentation, tokenization and layer algebra over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.operators import layers
from lexiframe.plans.common import documents


def sentence_regex(spark: SparkSession, d: str) -> DataFrame:
    return layers.sentences(documents(spark, d))


def token_regex(spark: SparkSession, d: str) -> DataFrame:
    return layers.tokens(documents(spark, d))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(layers.TOKEN), F.lit(0))).alias("t"))
    return t.groupBy(F.lower("t").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def token_whitespace(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(rf"[^{layers.WS}]+"), F.lit(0))
    t = documents(spark, d).select("doc_id", F.posexplode(words).alias("i", "token"))
    return t


def split_regex(spark: SparkSession, d: str) -> DataFrame:
    """Pieces between commas and semicolons, empty ones passed over."""
    p = F.filter(F.split("text", "[,;]"), lambda x: x != "")
    return documents(spark, d).select("doc_id", F.posexplode(p).alias("i", "piece"))


def newline_sentences(spark: SparkSession, d: str) -> DataFrame:
    return layers.lines(documents(spark, d))


def tokens_in_sentence(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    inside = layers.within(layers.tokens(docs), layers.sentences(docs))
    return inside.groupBy("doc_id", F.col("outer_begin").alias("begin"), F.col("outer_end").alias("end")).agg(F.count(F.lit(1)).alias("n_tokens"), F.min("token").alias("least_token"))


def tokens_near_sentence(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return layers.nearest(layers.sentences(docs), layers.tokens(docs))


def layer_union(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    s = layers.sentences(docs).select("doc_id", F.lit("sentence").alias("layer"), "begin", "end", F.col("sentence").alias("payload"))
    slab = layers.add_layer(s, layers.tokens(docs).withColumnRenamed("token", "payload"), "token")
    return slab.groupBy("doc_id").pivot("layer", ["sentence", "token"]).agg(F.count(F.lit(1)))


def layer_drop(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    s = layers.sentences(docs).select("doc_id", F.lit("sentence").alias("layer"), "begin", "end", F.col("sentence").alias("payload"))
    slab = layers.add_layer(s, layers.lines(docs).withColumnRenamed("line", "payload"), "line")
    return layers.remove_layer(slab, "sentence").groupBy("doc_id").agg(layers.has_layer(slab, "line").alias("has_line"), layers.has_layer(slab, "sentence").alias("has_sentence"), F.count(F.lit(1)).alias("n"))


def spanned_text(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    s = layers.sentences(docs).join(docs.select("doc_id", "text"), "doc_id")
    same = layers.spanned(s).select("doc_id", (F.col("covered") == F.col("sentence")).alias("same"))
    return same.groupBy("doc_id").agg(F.min("same").alias("all_same"), F.count(F.lit(1)).alias("n"))


def tsv_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line per sentence, its tokens parted by tabs."""
    docs = documents(spark, d)
    inside = layers.within(layers.tokens(docs), layers.sentences(docs))
    a = F.array_sort(F.collect_list(F.struct("begin", "token")))
    g = inside.groupBy("doc_id", "outer_begin").agg(a.alias("a"))
    return g.select("doc_id", F.col("outer_begin").alias("begin"), F.array_join(F.transform("a", lambda x: x["token"]), "\t").alias("line"))


def topk_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent tokens: a top-k report."""
    return token_counts(spark, d).orderBy(F.desc("n"), "token").limit(50)


def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(layers.TOKEN), F.lit(0)))
    b = documents(spark, d).where("text is not null").select((F.floor(n / 10) * 10).cast("int").alias("bucket"))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Text without tags; block tags become line breaks."""
    from lexiframe.sources import markup

    return documents(spark, d).where("text is not null").select("doc_id", markup.text(F.col("text")).alias("plain"))


def html_main_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text set into a page between a menu and a list of links, and its article taken out again."""
    from lexiframe.sources import markup

    menu = F.lit("<html><head><title>A page</title></head><body><ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li></ul><p>")
    links = F.lit("</p><div><a href='/1'>more of this</a> <a href='/2'>and of that</a></div></body></html>")
    body = F.replace(F.replace(F.regexp_replace("text", r"\s+", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(menu, body, links)
    p = documents(spark, d).where("text is not null").select("doc_id", page.alias("h"))
    return p.select("doc_id", markup.page_title(F.col("h")).alias("title"), markup.main_text(F.col("h")).alias("main"))


def word_vocabulary_difference(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of English documents that no other document has."""
    docs = documents(spark, d)
    words = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("token")).distinct()
    en = F.lower("lang") == "en"
    return words(docs.where(en)).join(words(docs.where(~F.coalesce(en, F.lit(False)))), "token", "left_anti")


QUERIES = {f.__name__: f for f in (
    sentence_regex, token_regex, token_counts, token_whitespace, split_regex, newline_sentences, tokens_in_sentence,
    tokens_near_sentence, layer_union, layer_drop, spanned_text, tsv_lines, topk_tokens, length_buckets, html_text, html_main_text,
    word_vocabulary_difference,
)}

_W = r" \t\n\x0B\f\r"
_PIECES = r"""
 {name}_p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS piece, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM documents),
 {name}_o AS (SELECT doc_id, piece, i, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS b FROM {name}_p)"""
_SENT = _PIECES.format(name="s", pattern=rf"[^{_W}.!?]+(?:[^.!?]+[.!?]|\z)|(?s:.)") + rf""",
 sent AS (SELECT doc_id, b AS "begin", CAST(b + length(piece) AS INT) AS "end", piece AS sentence,
   b + length(piece) = max(b + length(piece)) OVER (PARTITION BY doc_id) AS at_end FROM s_o
   QUALIFY length(piece) > 1 OR (at_end AND NOT regexp_matches(piece, '[{_W}.!?]')))"""
_TOKEN = _PIECES.format(name="t", pattern=r"\p{L}+|\p{P}+|\p{N}+|[^\p{L}\p{P}\p{N}]+") + r""",
 token AS (SELECT doc_id, b AS "begin", CAST(b + length(piece) AS INT) AS "end", piece AS token FROM t_o WHERE regexp_matches(piece, '^[\p{L}\p{P}\p{N}]'))"""
_COUNTS = r"SELECT lower(t) AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+|\p{P}+|\p{N}+')) AS t FROM documents) GROUP BY 1"
_INSIDE = """ inside AS (SELECT s.doc_id, s."begin" AS sb, s."end" AS se, t."begin" AS tb, t.token FROM sent s JOIN token t ON s.doc_id = t.doc_id AND t."begin" >= s."begin" AND t."end" <= s."end")"""

SQL = {
    "sentence_regex": f'WITH {_SENT} SELECT doc_id, "begin", "end", sentence FROM sent',
    "token_regex": f'WITH {_TOKEN} SELECT doc_id, "begin", "end", token FROM token',
    "token_counts": _COUNTS,
    "token_whitespace": rf"SELECT doc_id, CAST(i - 1 AS INT) AS i, token FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^{_W}]+') AS w FROM documents))",
    "split_regex": "SELECT doc_id, CAST(i - 1 AS INT) AS i, piece FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '[,;]'), lambda x: x <> '') AS p FROM documents))",
    "newline_sentences": "WITH" + _PIECES.format(name="l", pattern=r"[^\n]*\n+|[^\n]+") + r"""
 SELECT doc_id, b AS "begin", CAST(b + length(piece) AS INT) AS "end", piece AS line FROM l_o WHERE length(piece) > 1 OR piece <> chr(10)
 UNION ALL SELECT doc_id, CAST(length(text) AS INT), CAST(length(text) AS INT), '' FROM documents WHERE text = '' OR text LIKE '%' || chr(10)""",
    "tokens_in_sentence": f"WITH {_SENT}, {_TOKEN}, {_INSIDE} SELECT doc_id, sb AS \"begin\", se AS \"end\", count(*) AS n_tokens, min(token) AS least_token FROM inside GROUP BY 1, 2, 3",
    "tokens_near_sentence": f"""WITH {_SENT}, {_TOKEN},
 p AS (SELECT s.doc_id, s."begin" AS b, s."end" AS e, t."end" AS preceding_end FROM sent s ASOF LEFT JOIN token t ON s.doc_id = t.doc_id AND s."begin" >= t."end"),
 f AS (SELECT s.doc_id, s."begin" AS b, s."end" AS e, t."begin" AS following_begin FROM sent s ASOF LEFT JOIN token t ON s.doc_id = t.doc_id AND s."end" <= t."begin")
 SELECT doc_id, b AS "begin", e AS "end", preceding_end, following_begin FROM p JOIN f USING (doc_id, b, e)""",
    "layer_union": f"""WITH {_SENT}, {_TOKEN}, a AS (SELECT doc_id, 1 AS s, NULL AS t FROM sent UNION ALL SELECT doc_id, NULL, 1 FROM token)
 SELECT doc_id, nullif(count(s), 0) AS sentence, nullif(count(t), 0) AS token FROM a GROUP BY 1""",
    "layer_drop": "WITH" + _PIECES.format(name="l", pattern=r"[^\n]*\n+|[^\n]+") + r""",
 l AS (SELECT doc_id FROM l_o WHERE length(piece) > 1 OR piece <> chr(10) UNION ALL SELECT doc_id FROM documents WHERE text = '' OR text LIKE '%' || chr(10))
 SELECT doc_id, true AS has_line, false AS has_sentence, count(*) AS n FROM l GROUP BY 1""",
    "spanned_text": f"""WITH {_SENT} SELECT doc_id, bool_and(substring(text, "begin" + 1, "end" - "begin") = sentence) AS all_same, count(*) AS n FROM sent JOIN documents USING (doc_id) GROUP BY 1""",
    "tsv_lines": f"WITH {_SENT}, {_TOKEN}, {_INSIDE} SELECT doc_id, sb AS \"begin\", string_agg(token, chr(9) ORDER BY tb) AS line FROM inside GROUP BY 1, 2",
    "topk_tokens": f"SELECT token, n FROM ({_COUNTS}) ORDER BY n DESC, token LIMIT 50",
    "length_buckets": r"SELECT CAST(floor(len(regexp_extract_all(text, '\p{L}+|\p{P}+|\p{N}+')) / 10) * 10 AS INT) AS bucket, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "word_vocabulary_difference": r"""WITH w AS (SELECT DISTINCT coalesce(lower(lang) = 'en', false) AS en, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents)
 SELECT token FROM w WHERE en EXCEPT SELECT token FROM w WHERE NOT en""",
}
