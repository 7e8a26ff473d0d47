"""Frames and SQL fragments that several query modules start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.session import grows, spread, table


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "genre")


def delivered(spark: SparkSession, d: str) -> DataFrame:
    """The sentences as often as they were delivered: what is worked out in a row before dropDuplicates
    needn't be shuffled with all of the row."""
    return table(spark, d, "sentences").where("sent_id is not null and words is not null")


def _once(spark: SparkSession, d: str) -> DataFrame:
    s = delivered(spark, d)
    return s.select("sent_id", "docid", "idx", "words", "annotations", "section_id", "source").dropDuplicates(["sent_id"])


def one_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Each sentence once, however often it was delivered."""
    return grows(_once(spark, d))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(sent_id, pos, word): words stripped of spaces; a null word is an empty one."""
    return one_sentences(spark, d).select("sent_id", F.posexplode("words").alias("pos", "w")).select("sent_id", "pos", F.coalesce(F.trim("w"), F.lit("")).alias("word"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    """(sent_id, pos, tag): one tag per token, the first by code points where rows differ."""
    t = table(spark, d, "pos_tags").where("sent_id is not null and tok_idx is not null")
    t = t.select("sent_id", F.col("tok_idx").alias("pos"), F.upper(F.trim("tag")).alias("tag")).where("tag <> ''")
    return grows(t.groupBy("sent_id", "pos").agg(F.min("tag").alias("tag")))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """(sent_id, pos, word, tag)."""
    return grows(tokens(spark, d).join(tags(spark, d), ["sent_id", "pos"]))


def tagged_sentences(spark: SparkSession, d: str) -> DataFrame:
    """(sent_id, held, pos, word, tag): tagged(), with what is of dev and test portions marked. Words and
    tags are shuffled once, by sentence, and stay so: what is grouped by sentence next is in place."""
    s = table(spark, d, "sentences").where("sent_id is not null and words is not null").select("sent_id", "words")
    s = spread(s, "sent_id").dropDuplicates(["sent_id"])
    t = table(spark, d, "pos_tags").where("sent_id is not null and tok_idx is not null")
    t = spread(t.select("sent_id", F.col("tok_idx").alias("pos"), F.upper(F.trim("tag")).alias("tag")).where("tag <> ''"), "sent_id")
    t = t.groupBy("sent_id", "pos").agg(F.min("tag").alias("tag")).groupBy("sent_id").agg(F.collect_list(F.struct("pos", "tag")).alias("tags"))
    s = marked(grows(grows(s).join(grows(t), "sent_id")), spark, d)
    s = s.select("sent_id", "held", "words", F.inline("tags")).where("pos >= 0 and pos < size(words)")
    return s.select("sent_id", "held", "pos", F.coalesce(F.trim(F.get("words", F.col("pos").cast("int"))), F.lit("")).alias("word"), "tag")


def tagged_arrays(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """(sent_id, cols, tokens ARRAY<STRUCT<pos, word, tag>>): tagged() by sentence, in order, each table shuffled once."""
    s = delivered(spark, d).select("sent_id", "words", *cols).dropDuplicates(["sent_id"])
    t = table(spark, d, "pos_tags").where("sent_id is not null and tok_idx is not null")
    t = t.select("sent_id", F.struct(F.col("tok_idx").alias("pos"), F.upper(F.trim("tag")).alias("tag")).alias("x")).where("x.tag <> ''")
    t = t.groupBy("sent_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    s = grows(s).join(grows(t), "sent_id")
    first = lambda x, i: (x["pos"] >= 0) & (x["pos"] < F.size("words")) & ((i == 0) | (F.get("x", i - 1)["pos"] != x["pos"]))
    word = lambda x: F.coalesce(F.trim(F.get("words", x["pos"].cast("int"))), F.lit(""))
    one = F.transform(F.filter("x", first), lambda x: F.struct(x["pos"].alias("pos"), word(x).alias("word"), x["tag"].alias("tag")))
    return grows(s.select("sent_id", *cols, one.alias("tokens")))


def marked(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Adds `held`: is the sentence of a dev or test portion? df is spread by sentence and stays so."""
    held = spread(_held_ids(spark, d), "sent_id").withColumn("held", F.lit(True))
    return df.join(grows(held), "sent_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def held_sections(spark: SparkSession, d: str) -> DataFrame:
    """(section_id) of dev and test portions."""
    p = table(spark, d, "portions").where("lower(portion_name) in ('dev', 'test')").select(F.explode("sections").alias("section_id"))
    return p.where("section_id is not null").distinct()


def _held_ids(spark: SparkSession, d: str) -> DataFrame:
    """Sentences whose section stands in a dev or test portion."""
    return grows(_once(spark, d).join(held_sections(spark, d), "section_id", "left_semi").select("sent_id"))


def held_out(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Rows of sentences of dev and test portions."""
    return grows(df.join(_held_ids(spark, d), "sent_id", "left_semi"))


def training(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Rows of all other sentences."""
    return grows(df.join(_held_ids(spark, d), "sent_id", "left_anti"))


ONE = """ one AS (SELECT DISTINCT ON (sent_id) sent_id, docid, idx, words, annotations, section_id, source FROM sentences
   WHERE sent_id IS NOT NULL AND words IS NOT NULL),
 held AS (SELECT sent_id FROM one WHERE section_id IN (SELECT unnest(sections) FROM portions WHERE lower(portion_name) IN ('dev', 'test')))"""
TOK = ONE + """,
 tok AS (SELECT sent_id, pos - 1 AS pos, coalesce(trim(words[pos]), '') AS word
   FROM (SELECT sent_id, words, unnest(range(1, len(words) + 1)) AS pos FROM one))"""
TAG = """ tag AS (SELECT sent_id, tok_idx AS pos, min(upper(trim(tag))) AS tag FROM pos_tags
   WHERE sent_id IS NOT NULL AND tok_idx IS NOT NULL AND trim(tag) <> '' GROUP BY 1, 2)"""
TAGGED = TOK + "," + TAG + ", tagged AS (SELECT sent_id, pos, word, tag FROM tok JOIN tag USING (sent_id, pos))"
