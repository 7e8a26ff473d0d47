"""Feature dictionaries: ids, encoding, redundancy, cross products, offsets, hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_index(features: DataFrame, at_least: int = 1) -> DataFrame:
    """(feature, id, n): ids from 0 in the order of the features, those seen fewer than at_least
    times left out.

    Ids are ranks within hash-free range partitions plus the sizes of the partitions before, so no
    task sorts all features.
    """
    c = features.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    r = c.repartitionByRange("feature").withColumn("part", F.spark_partition_id()).withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("feature")))
    from lexiframe.session import cut

    r = cut(r)
    sizes = sorted((x["part"], x["k"]) for x in r.groupBy("part").agg(F.count(F.lit(1)).alias("k")).collect())  # a row per partition
    at, starts = 0, []
    for part, k in sizes:
        starts.append((part, at))
        at += k
    if not starts:
        return r.select("feature", F.lit(0).cast("bigint").alias("id"), "n")
    start = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    return r.select("feature", (F.col("rank") - 1 + start[F.col("part")]).cast("bigint").alias("id"), "n")


def encode(features: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with their feature's id; unknown features are dropped."""
    return features.join(index.select("feature", "id"), "feature").drop("feature")


def non_redundant(occurrences: DataFrame) -> DataFrame:
    """(feature): of the features (context, feature) that occur in exactly the same contexts, the
    smallest one. Context sets are compared by count and two hashes of their members."""
    c = occurrences.select("context", "feature").distinct()
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "context").cast("decimal(38,0)"))
    sets = c.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), h(1).alias("h1"), h(2).alias("h2"))
    return sets.groupBy("n", "h1", "h2").agg(F.min("feature").alias("feature")).select("feature")


def cross_index(pairs: DataFrame, at_least: int = 1) -> DataFrame:
    """(label, feature, n): label-feature pairs seen at least so often."""
    return pairs.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def hashed(label: Column, feature: Column, buckets: int) -> Column:
    """A bucket for a pair that has no id."""
    return F.pmod(F.xxhash64(label, feature), F.lit(buckets))


def segmented(indexes: list[DataFrame]) -> DataFrame:
    """(segment, feature, id): several dictionaries one behind the other."""
    at, out = 0, None
    for i, x in enumerate(indexes):
        part = x.select(F.lit(i).alias("segment"), "feature", (F.col("id") + at).alias("id"))
        out = part if out is None else out.unionByName(part)
        at += x.count()
    return out


def with_hashed(pairs: DataFrame, at_least: int, buckets: int) -> DataFrame:
    """(label, feature, n, hashed, cell): pairs seen so often have a cell of their own, all others one
    of `buckets` shared ones behind them, by the hash of label and feature."""
    c = pairs.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n")).withColumn("hashed", F.col("n") < at_least)
    cell = F.when(F.col("hashed"), F.concat(F.lit("h"), hashed(F.col("label"), F.col("feature"), buckets).cast("string"))).otherwise(F.concat_ws("|", "label", "feature"))
    return c.withColumn("cell", cell)
