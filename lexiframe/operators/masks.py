"""Bit sets over places, their algebra, and Bloom filters over values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_sets(places: DataFrame, by: str = "sent_id", pos_col: str = "pos") -> DataFrame:
    """(by, bits ARRAY<BIGINT>): the places of each group as words of 64 bits; negative and null ones
    are left out. A group's array is as long as its last place needs."""
    p = places.where(F.col(pos_col) >= 0).select(by, F.floor(F.col(pos_col) / 64).cast("int").alias("word"), (F.col(pos_col) % 64).cast("int").alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    w = p.groupBy(by, "word").agg(F.bit_or(one).alias("x"))
    m = w.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("word", "x"))).alias("m"), F.max("word").alias("last"))
    return m.select(by, F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("bits"))


def _zip(a: Column, b: Column, f) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.zip_with(a, b, lambda x, y: f(F.coalesce(x, zero), F.coalesce(y, zero)))


def combine(a: DataFrame, b: DataFrame, by: str = "sent_id") -> DataFrame:
    """(by, both, either, first_only, one_only): and, or, and-not and exclusive or of two bit sets;
    an absent group is an empty set."""
    none = F.array().cast("array<bigint>")
    j = a.select(by, F.col("bits").alias("x")).join(b.select(by, F.col("bits").alias("y")), by, "full_outer")
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    return j.select(
        by,
        _zip(x, y, lambda p, q: p.bitwiseAND(q)).alias("both"),
        _zip(x, y, lambda p, q: p.bitwiseOR(q)).alias("either"),
        _zip(x, y, lambda p, q: p.bitwiseAND(F.bitwise_not(q))).alias("first_only"),
        _zip(x, y, lambda p, q: p.bitwiseXOR(q)).alias("one_only"),
    )


def _slots(value: Column, size: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), value), F.lit(size)).cast("int") for i in range(hashes)])


def bloom(values: DataFrame, col: str, size: int, hashes: int) -> DataFrame:
    """(word, x): the set 64-bit words of a Bloom filter of `size` bits; null values are left out.
    Filters of two frames are united by taking the bit-or of each word."""
    s = values.where(F.col(col).isNotNull()).select(F.explode(_slots(F.col(col), size, hashes)).alias("slot"))
    return s.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("slot") % 64).cast("int"))).alias("x"))


def unite(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("word").agg(F.bit_or("x").alias("x"))


def approximate_size(filter_: DataFrame, size: int, hashes: int) -> DataFrame:
    """(n_values): how many values a filter holds, -m ln(1 - load) / k."""
    load = F.coalesce(F.sum(F.bit_count("x")), F.lit(0)) / F.lit(float(size))
    return filter_.agg((-size * F.log(1 - load) / hashes).alias("n_values"))


def bloom_hits(values: DataFrame, col: str, filter_: DataFrame, size: int, hashes: int) -> DataFrame:
    """Adds `hit`: may the value be in the filter? The filter has size / 64 words at most, a bound of
    its own, so it is sent to all as one array."""
    words = {r["word"]: r["x"] for r in filter_.collect()}  # size / 64 rows at most
    bits = F.lit([words.get(i, 0) for i in range(-(-size // 64))]).cast("array<bigint>")
    inside = F.forall(_slots(F.col(col), size, hashes), lambda s: F.getbit(F.element_at(bits, (F.floor(s / 64) + 1).cast("int")), (s % 64).cast("int")) == 1)
    return values.withColumn("hit", F.coalesce(inside, F.lit(False)))
