"""python -m lexiframe segment|tokenize|tags|parse INPUT OUTPUT: texts in, texts out.

INPUT is a folder or file of texts, one document per file; OUTPUT a folder of text files, in which each
line is one sentence: as it stands, its tokens, or its tokens' word/tag pairs or its tree by a model
trained on the tagged corpus in the folder given with --corpus.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.operators import layers, parsing, sequence, treebank
from lexiframe.plans import models
from lexiframe.session import ship


def sentences_of(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, end, sentence) of texts."""
    return docs.transform(layers.sentences)


def tokens_of(docs: DataFrame) -> DataFrame:
    """(sent_id, doc_id, begin, pos, word): treebank tokens of each sentence, sentences numbered by a hash."""
    t = treebank.tokens(sentences_of(docs), "doc_id", "sentence", ("begin",))
    return t.select(F.xxhash64("doc_id", "begin").alias("sent_id"), "doc_id", "begin", F.col("i").alias("pos"), F.col("token").alias("word"))


def lines_of(docs: DataFrame, what: str, corpus: str | None = None) -> DataFrame:
    """(doc_id, begin, value): one line per sentence."""
    spark = docs.sparkSession
    if what == "segment":
        return sentences_of(docs).select("doc_id", "begin", F.regexp_replace("sentence", r"\s+", " ").alias("value"))
    t = tokens_of(docs)
    if what == "parse":
        g = parsing.parse(t.select("sent_id", "pos", "word"), *models._parser(spark, corpus))
        return g.join(t.select("sent_id", "doc_id", "begin").distinct(), "sent_id").select("doc_id", "begin", F.col("tree").alias("value"))
    if what == "tags":
        tagged = sequence.decode(t.select("sent_id", "pos", "word"), models._hmm(spark, corpus))
        t = t.join(tagged, ["sent_id", "pos"]).withColumn("word", F.concat_ws("/", "word", "tag"))
    a = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return t.groupBy("doc_id", "begin").agg(F.array_join(F.transform(a, lambda x: x["word"]), " ").alias("value"))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexiframe", description=__doc__)
    p.add_argument("what", choices=["segment", "tokenize", "tags", "parse"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--corpus", help="folder with the tables sentences, pos_tags and portions; for tags and parse")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lexiframe").getOrCreate()
    ship(spark)
    docs = spark.read.text(a.input, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    out = lines_of(docs, a.what, a.corpus)
    out.repartition("doc_id").sortWithinPartitions("doc_id", "begin").select("value").write.mode("error").text(a.output)


if __name__ == "__main__":
    main()
