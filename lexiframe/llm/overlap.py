"""Same or near-same records across splits (problem 3).

Every distinct word set gets a bit code of BITS bits in which each word sets one bit. Two sets with
|A and B| / |A or B| >= t differ in at most (1 - t) / (1 + t) * (|A| + |B|) words, and each of these
changes at most one bit, so the Hamming distance of the codes can't exceed that radius r.

The code's bits are permuted and cut into r + EQUAL segments; within the radius at least EQUAL
segments of two codes are equal. The joined code blocks are grown along the first equal segments: a
block is one segment; where a block is held by so many sets of both sides that it would give more
than CROWD candidates per set, it is replaced by the blocks of two segments that begin with it, and
those, again where needed, by blocks of EQUAL segments. Two codes see the same crowding of a block
they share, so they meet at its finest crowded-or-not form, and no pair within the radius is lost.
As the permutation depends on the radius, a set has blocks for every radius that its partners' sizes
allow; radii above SMALL are rounded up in steps, so that the number of blocks is linear in its size.

Candidates within the radius are verified on the words themselves; the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.session import cut, release

#: Bits of the code, and of its fold that goes along with the blocks.
BITS, FOLD = 4096, 128
#: Segments that are equal within the radius: the most that a block is made of.
EQUAL = 3
#: Candidates per set of a block above which it is refined.
CROWD = 256
#: Radii up to this have segments of their own; above it they are rounded up by a seventh at most.
SMALL = 14
#: Parts that a block of EQUAL segments is split into where it is still crowded.
SALT = 64
EDGE = " \t\n\x0b\f\r\u00a0\u3000"


def word_set(words: Column) -> Column:
    """Sorted distinct words, lower-cased, stripped, those without a letter or digit left out."""
    clean = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(EDGE)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda w: w.rlike(r"[\p{L}\p{N}]"))))


def section_splits(portions: DataFrame) -> DataFrame:
    """(section_id, split) of portions (sections, portion_name); repeated and null entries fall away."""
    p = portions.select(F.explode("sections").alias("section_id"), F.lower(F.trim("portion_name")).alias("split"))
    return p.where("section_id is not null and split is not null").distinct()


def _fold(words: Column) -> list[Column]:
    """The code folded to two 64-bit halves: a word sets the bit that its hash names."""
    h = lambda w: F.pmod(F.xxhash64(w), F.lit(FOLD)).cast("int")
    one = F.lit(1).cast("bigint")

    def half(lo: int) -> Column:
        inside = F.filter(F.transform(words, h), lambda b: (b >= lo) & (b < lo + 64))
        return F.aggregate(inside, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, b - lo)))

    return [half(0), half(64)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: near inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def radii(threshold: float, largest: int) -> list[int]:
    """The radii that have segments: all up to SMALL, then steps of a seventh, past those of the largest set."""
    top = math.floor((1 - threshold) / (1 + threshold) * (largest + largest / threshold) + 1e-9)
    out = list(range(SMALL + 1))
    while out[-1] < top:
        out.append(out[-1] + max(1, out[-1] // 7))
    return out


def segment_codes(starts: np.ndarray, bits: np.ndarray, radius: int) -> np.ndarray:
    """(sets, radius + EQUAL): the code of every segment of every set; 0 for segments without a bit.

    bits holds the bit numbers of all sets, starts where each set's begin. A segment's code is the
    exclusive or of its bits' random keys.
    """
    m = radius + EQUAL
    every = np.arange(BITS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        segment = (_mix(every * np.uint64(0x9E3779B97F4A7C15) + np.uint64(radius + 1)) % np.uint64(m)).astype(np.int64)
        key = _mix(every + np.uint64(1))
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    out = np.zeros(n * m, dtype=np.uint64)
    np.bitwise_xor.at(out, row * m + segment[bits], key[bits])
    return out.reshape(n, m)


def block_keys(codes: np.ndarray, radius: int, chain: list[np.ndarray]) -> np.ndarray:
    """One key per row for the segments that the arrays of `chain` name, in this order."""
    rows = np.arange(len(codes))
    with np.errstate(over="ignore"):
        h = np.full(len(codes), radius * 8 + len(chain), dtype=np.uint64)
        for at in chain:
            h = _mix(h * np.uint64(31) + codes[rows, at] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


#: An ask is a radius and the segments of a chain so far, each in so many bits.
_WIDE = 18
_ROW = ("rep", "n", "in_train", "in_eval", "b0", "b1")
_BLOCKS = "block bigint, ask bigint, rep bigint, n int, in_train boolean, in_eval boolean, b0 bigint, b1 bigint"


def _blocks(sets: DataFrame, depth: int, all_radii: list[int], threshold: float, min_words: int) -> DataFrame:
    """Blocks of `depth` segments of sets (rep, n, in_train, in_eval, b0, b1, bits, asks), with the
    ask that would refine them. At depth 1 a set asks for all its radii, else for those of `asks`."""
    c = (1 - threshold) / (1 + threshold)
    levels = np.array(all_radii)

    def all_asks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.maximum(np.ceil(threshold * n - 1e-9), min_words)
        low = np.searchsorted(levels, np.floor(c * (n + least) + 1e-9))
        high = np.searchsorted(levels, np.floor(c * (n + np.floor(n / threshold + 1e-9)) + 1e-9))
        times = np.maximum(high - low + 1, 0)
        at = np.repeat(np.arange(len(n)), times)
        return at, levels[np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            bits = b["bits"].to_list()
            if depth == 1:
                of, radius_of = all_asks(b["n"].to_numpy().astype(np.float64))
                ask = radius_of << (_WIDE * (EQUAL - 1))
            else:
                of = np.repeat(np.arange(len(b)), b["asks"].map(len).to_numpy())
                ask = np.concatenate(b["asks"].to_list())
                radius_of = ask >> (_WIDE * (EQUAL - 1))
            own = {k: b[k].to_numpy() for k in _ROW}
            for radius in np.unique(radius_of):
                rows = np.flatnonzero(radius_of == radius)
                here, place = np.unique(of[rows], return_inverse=True)
                codes = segment_codes(np.r_[0, np.cumsum([len(bits[i]) for i in here])], np.concatenate([bits[i] for i in here]).astype(np.int64), int(radius))
                chain = [(ask[rows] >> (_WIDE * i)) & ((1 << _WIDE) - 1) for i in range(depth - 1)]
                # the next segment of a chain lies behind it and leaves room for those that must follow
                first = chain[-1] + 1 if chain else np.zeros(len(rows), dtype=np.int64)
                times = np.maximum(int(radius) + depth - first, 0)
                at = np.repeat(np.arange(len(rows)), times)
                nxt = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
                keys = block_keys(codes[place[at]], int(radius), [*(x[at] for x in chain), nxt])
                finer = ask[rows][at] | nxt << (_WIDE * (depth - 1)) if depth < EQUAL else ask[rows][at]
                yield pd.DataFrame({"block": keys, "ask": finer, **{k: v[here[place[at]]] for k, v in own.items()}})

    return sets.mapInPandas(run, _BLOCKS)


def candidates(sets: DataFrame, threshold: float, min_words: int) -> DataFrame:
    """(train_rep, eval_rep): distinct pairs of sets (rep, words, n, in_train, in_eval) whose folded
    codes lie within the radius and that share a block; every pair that reaches the threshold is one."""
    largest = sets.agg(F.max("n")).first()[0] or 0
    all_radii = radii(threshold, largest)
    bits = F.array_sort(F.array_distinct(F.transform("words", lambda w: F.pmod(F.xxhash64(F.lit(5), w), F.lit(BITS)).cast("int"))))
    fold = _fold(F.col("words"))
    coded = cut(sets.select("rep", "n", "in_train", "in_eval", fold[0].alias("b0"), fold[1].alias("b1"), bits.alias("bits")))
    todo = coded
    scratch = [coded]
    found_ = []
    radius = F.floor(F.lit((1 - threshold) / (1 + threshold)) * (F.col("na") + F.col("nb")) + F.lit(1e-9))
    far = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    # a pair belongs to the blocks of one radius: the least that is no smaller than its own
    level = F.when(radius <= SMALL, radius).otherwise(F.element_at(F.filter(F.lit(all_radii), lambda x: x >= radius), 1))
    own = level == F.shiftright("ask", _WIDE * (EQUAL - 1))
    for depth in range(1, EQUAL + 1):
        b = cut(_blocks(todo, depth, all_radii, threshold, min_words))
        held = b.groupBy("block").agg(F.count_if("in_train").alias("nt"), F.count_if("in_eval").alias("ne"))
        crowded = F.col("nt") * F.col("ne") > CROWD * (F.col("nt") + F.col("ne"))
        held = cut(held.where("nt > 0 and ne > 0").select("block", crowded.alias("crowded")))
        scratch += [b, held]
        shared = b.join(held, "block")
        final = shared if depth == EQUAL else shared.where("not crowded")
        # only blocks that can't be refined any more may be crowded still
        last = depth == EQUAL
        parts = F.when(F.col("crowded"), F.lit(SALT)).otherwise(F.lit(1))
        every = F.explode(F.sequence(F.lit(0), parts - 1)) if last else F.lit(0)
        left = final.where("in_train").select("block", every.alias("part"), "ask", F.col("rep").alias("train_rep"), F.col("n").alias("na"), F.col("b0").alias("a0"), F.col("b1").alias("a1"))
        right = final.where("in_eval").select("block", (F.pmod(F.xxhash64("rep"), parts).cast("int") if last else F.lit(0)).alias("part"), F.col("rep").alias("eval_rep"), F.col("n").alias("nb"), "b0", "b1")
        met = left.join(right, ["block", "part"]).where((F.col("train_rep") != F.col("eval_rep")) & (far <= radius) & own)
        met = cut(met.select("train_rep", "eval_rep").distinct())
        scratch.append(met)
        found_.append(met)
        if depth < EQUAL:
            # at most as many asks per set as it has blocks
            again = shared.where("crowded").groupBy("rep").agg(F.collect_list("ask").alias("asks"))
            todo = coded.join(again, "rep")
    near = found_[0]
    for met in found_[1:]:
        near = near.unionByName(met)
    out = cut(near.distinct())
    for x in scratch:
        release(x)
    return out


def overlaps(sentences: DataFrame, portions: DataFrame, threshold: float = 0.75, min_words: int = 10, train: str = "train") -> tuple[DataFrame, DataFrame]:
    """Class pairs and members.

    pairs (train_rep, eval_rep, n_common, n_union): classes of equal word sets, one held by the train
    split, one by another, with |common| / |union| >= threshold; a class with members on both sides
    pairs with itself. members (rep, sent_id, split, source): rep is the smallest sent_id of the
    class. Sentences are taken once per sent_id; those in no split, with null words or fewer than
    min_words distinct words take no part.
    """
    # what is in no split or too short anyway is dropped before its words are looked at
    s = sentences.where("sent_id is not null and words is not null and section_id is not null").where(F.size("words") >= min_words)
    s = s.select("sent_id", "section_id", "source", "words").join(section_splits(portions), "section_id")
    s = s.select("sent_id", "split", "source", word_set(F.col("words")).alias("words")).where(F.size("words") >= min_words)
    # a set is known by 128 bits of its words' hash, so its words are shuffled once
    key = F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b"))
    s = cut(s.withColumn("set", key))
    is_train = F.col("split") == train
    sets = s.groupBy("set").agg(F.first("words").alias("words"), F.min("sent_id").alias("rep"), F.max(is_train).alias("in_train"), F.max(~is_train).alias("in_eval"))
    sets = cut(sets.withColumn("n", F.size("words")))
    # a sentence counts once per split, however often it was delivered
    one = s.groupBy("sent_id", "split").agg(F.min_by(F.struct("set", "source"), F.struct("set", "source")).alias("m"))
    members = one.select("sent_id", "split", "m.set", "m.source").join(sets.select("set", "rep"), "set").select("rep", "sent_id", "split", "source")
    near = candidates(sets, threshold, min_words)
    wa = sets.select(F.col("rep").alias("train_rep"), F.col("words").alias("wa"))
    wb = sets.select(F.col("rep").alias("eval_rep"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    v = near.join(wa, "train_rep").join(wb, "eval_rep").withColumn("n_common", both).withColumn("n_union", F.size("wa") + F.size("wb") - F.col("n_common"))
    v = v.where(F.col("n_common") >= F.lit(threshold) * F.col("n_union") - F.lit(1e-9)).select("train_rep", "eval_rep", "n_common", "n_union")
    same = sets.where("in_train and in_eval").select(F.col("rep").alias("train_rep"), F.col("rep").alias("eval_rep"), F.col("n").alias("n_common"), F.col("n").alias("n_union"))
    return v.unionByName(same), members


def found(sentences: DataFrame, portions: DataFrame, threshold: float = 0.75, min_words: int = 10) -> DataFrame:
    """(sent_id_a, sent_id_b), a < b: all pairs of sentences of problem 3."""
    pairs, members = overlaps(sentences, portions, threshold, min_words)
    ta = members.where("split = 'train'").select(F.col("rep").alias("train_rep"), F.col("sent_id").alias("x")).distinct()
    ev = members.where("split <> 'train'").select(F.col("rep").alias("eval_rep"), F.col("sent_id").alias("y")).distinct()
    out = pairs.select("train_rep", "eval_rep").join(ta, "train_rep").join(ev, "eval_rep").where("x <> y")
    return out.select(F.least("x", "y").alias("sent_id_a"), F.greatest("x", "y").alias("sent_id_b")).distinct()


def report(sentences: DataFrame, portions: DataFrame, threshold: float = 0.75, min_words: int = 10) -> DataFrame:
    """(split, source, n_sent, n_links): per evaluation split and source, the sentences that overlap
    with train and the number of train sentences they overlap with; copies are not expanded."""
    pairs, members = overlaps(sentences, portions, threshold, min_words)
    members = cut(members)
    size = members.where("split = 'train'").groupBy(F.col("rep").alias("train_rep")).agg(F.countDistinct("sent_id").alias("n"))
    per = pairs.join(size, "train_rep").groupBy("eval_rep").agg(F.sum("n").alias("n"))
    ev = members.where("split <> 'train'").withColumnRenamed("rep", "eval_rep")
    return ev.join(per, "eval_rep").groupBy("split", "source").agg(F.countDistinct("sent_id").alias("n_sent"), F.sum("n").cast("bigint").alias("n_links"))
