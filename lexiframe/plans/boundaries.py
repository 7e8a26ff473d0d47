"""The trained segmenter on texts made of the sentences, and tokens by a pattern and by locale."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiframe.operators import boundary, evaluation, layers
from lexiframe.plans.common import documents, held_out, one_sentences, training
from lexiframe.session import cut

#: Sentences of one made text.
RUN = 20


def _texts(sentences):
    """(id, text, ends): stretches of sentences of a section, their words joined by spaces, with the end of each."""
    clean = F.filter(F.transform("words", lambda w: F.trim(w)), lambda w: w.isNotNull() & (w != ""))
    s = sentences.select("sent_id", F.floor(F.col("sent_id") / RUN).alias("id"), F.regexp_replace(F.array_join(clean, " "), r" ([.,!?;:])", "$1").alias("s")).where("s <> ''")
    w = Window.partitionBy("id").orderBy("sent_id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("end", (F.coalesce(F.sum(F.length("s") + 1).over(w), F.lit(0)) + F.length("s")).cast("int"))
    a = s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "s", "end"))).alias("a"))
    return a.select("id", F.array_join("a.s", " ").alias("text"), F.col("a.end").alias("ends"))


def _weights(spark, d):
    return boundary.fit(cut(boundary.rows(_texts(training(one_sentences(spark, d), spark, d)), "id", "text", "ends")))


def trained_segmenter(spark, d):
    """Precision and recall of sentence ends on texts made of the held-out sentences."""
    t = cut(_texts(held_out(one_sentences(spark, d), spark, d)))
    gold = boundary.rows(t, "id", "text", "ends").where("label = 'end'").select("id", "at")
    guess = boundary.split(t, _weights(spark, d), "id", "text").select("id", (F.col("end") - 1).alias("at"))
    return evaluation.precision_recall(gold, guess, ["id", "at"])


def trained_sentences(spark, d):
    """Sentences of all documents by the trained segmenter."""
    return boundary.split(documents(spark, d).select("doc_id", "text"), _weights(spark, d), "doc_id", "text")


def locale_sentences(spark, d):
    """Sentences and words of each document by the locale's break iterator, counted."""
    s = documents(spark, d).where("text <> ''").select("doc_id", F.sentences("text", F.lower(F.coalesce("lang", F.lit("en"))), F.lit("")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.aggregate("s", F.lit(0), lambda n, x: n + F.size(x)).alias("n_words"))


def pattern_tokens(spark, d):
    """All matches of a pattern: here runs of letters with inner hyphens, with their offsets."""
    t = layers.matches(documents(spark, d), r"\p{L}+(?:-\p{L}+)*")
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("begin").cast("bigint").alias("begins"), F.sum(F.length("token")).cast("bigint").alias("letters"))


QUERIES = {f.__name__: f for f in (trained_segmenter, trained_sentences, locale_sentences, pattern_tokens)}
SQL = {
    "pattern_tokens": r"""WITH p AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+(?:-\p{L}+)*|[^\p{L}]+') AS a FROM documents)),
 o AS (SELECT doc_id, s, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
 SELECT doc_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS begins, CAST(sum(length(s)) AS BIGINT) AS letters FROM o WHERE regexp_matches(s, '^\p{L}') GROUP BY 1""",
}
