"""Evaluation: tagging accuracy, confusions, segment and bracket scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tagging(pairs: DataFrame) -> DataFrame:
    """One row (n_tokens, n_right, n_sentences, n_exact) for (sent_id, pos, gold, pred)."""
    s = pairs.groupBy("sent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("r"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return s.agg(zero(F.sum("n")).alias("n_tokens"), zero(F.sum("r")).alias("n_right"), F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("n") == F.col("r")).alias("n_exact"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(gold: DataFrame, guess: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """(n_gold, n_guess, n_right, precision, recall, f1), whole or by group, over sets of rows."""
    g = gold.select(*keys).distinct().withColumn("side", F.lit(1))
    p = guess.select(*keys).distinct().withColumn("side", F.lit(2))
    both = g.unionByName(p).groupBy(*keys).agg(F.sum("side").alias("side"))
    counts = [F.count_if(F.col("side") != 2).alias("n_gold"), F.count_if(F.col("side") != 1).alias("n_guess"), F.count_if(F.col("side") == 3).alias("n_right")]
    t = both.groupBy(*(by or [])).agg(*counts)
    part = lambda a, b: F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.col(a) / F.col(b))
    t = t.withColumn("precision", F.round(part("n_right", "n_guess"), 6)).withColumn("recall", F.round(part("n_right", "n_gold"), 6))
    return t.withColumn("f1", F.round(F.when(F.col("n_gold") + F.col("n_guess") == 0, F.lit(1.0)).otherwise(2 * F.col("n_right") / (F.col("n_gold") + F.col("n_guess"))), 6))


# Labels that don't count as brackets.
IGNORED = ("", "TOP", "''", "``", ".", ":", ",")


def brackets(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """One row (n_gold, n_guess, n_right, precision, recall, f1, n_sentences, n_exact, n_tags, n_tags_right)
    for node tables of the same sentences: labelled brackets as sets, so repeated ones count once,
    without those of IGNORED labels; tags compared place by place; a sentence is exact when its sets
    are equal. Sentences that only one side has count against it."""
    inner = lambda df: df.where(F.col("word").isNull() & ~F.col("label").isin(*IGNORED)).select("sent_id", "label", "begin", "end").distinct()
    both = inner(gold).withColumn("side", F.lit(1)).unionByName(inner(guess).withColumn("side", F.lit(2))).groupBy("sent_id", "label", "begin", "end").agg(F.sum("side").alias("side"))
    per = both.groupBy("sent_id").agg(F.count_if(F.col("side") != 2).alias("g"), F.count_if(F.col("side") != 1).alias("p"), F.count_if(F.col("side") == 3).alias("r"))
    leaf = lambda df, name: df.where(F.col("word").isNotNull() & (F.col("end") > F.col("begin"))).select("sent_id", F.col("begin").alias("pos"), F.col("label").alias(name))
    tags = leaf(gold, "a").join(leaf(guess, "b"), ["sent_id", "pos"], "left").agg(F.count(F.lit(1)).alias("n_tags"), F.count_if(F.col("a") == F.col("b")).alias("n_tags_right"))
    everyone = gold.select("sent_id").distinct().join(per, "sent_id", "left").fillna(0)
    s = everyone.agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_guess"), F.sum("r").alias("n_right"), F.count(F.lit(1)).alias("n_sentences"), F.count_if((F.col("g") == F.col("r")) & (F.col("p") == F.col("r"))).alias("n_exact"))
    part = lambda a, b: F.round(F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.col(a) / F.col(b)), 6)
    s = s.withColumn("precision", part("n_right", "n_guess")).withColumn("recall", part("n_right", "n_gold"))
    return s.withColumn("f1", F.round(2 * F.col("n_right") / (F.col("n_gold") + F.col("n_guess")), 6)).crossJoin(tags)  # both are one row


def sentiment_accuracy(cells: DataFrame) -> DataFrame:
    """(fine, ternary, binary) of cells (gold, pred, n) over five classes; 2 is neutral. Binary leaves
    out neutral gold and asks for the side of the prediction."""
    side = lambda c: F.signum(F.col(c) - 2)
    n = F.sum("n")
    right = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    polar = F.col("gold") != 2
    return cells.agg(
        F.round(right(F.col("gold") == F.col("pred")) / n, 4).alias("fine"),
        F.round(right(side("gold") == side("pred")) / n, 4).alias("ternary"),
        F.round(right(polar & (side("gold") == side("pred"))) / right(polar), 4).alias("binary"),
    )


def normalize(n: Column, by) -> Column:
    """Log of the share of a count in its group; by is a window partitioned by the group."""
    return F.log(n / F.sum(n).over(by))
