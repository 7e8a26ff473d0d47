"""Word-vector tables: text and binary readers, lookup forms, merging and completion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.functions.words import vector_key


def from_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(word, vec) of lines `word x1 x2 …`, parted by tabs or blanks; a first line of two numbers
    (count and size) and malformed lines are passed over."""
    p = F.split(F.trim(col), r"[\t ]+")
    v = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x.try_cast("float"))
    header = (F.size(p) == 2) & p[0].rlike("^[0-9]+$")
    return lines.select(p[0].alias("word"), v.alias("vec"), header.alias("header"), F.size(p).alias("n")).where("not header and n > 1").where(~F.exists("vec", lambda x: x.isNull())).select("word", "vec")


def read_binary(spark: SparkSession, path: str, vocabulary: DataFrame | None = None, bias: bool = False) -> DataFrame:
    """(word, vec) of binary vector files: a text header, then words each followed by float32s; only
    words of the vocabulary (word) if one is given, with a last entry of 1 if there is to be a bias."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                head, _, data = bytes(content).partition(b"\n")
                n, dim = map(int, head.split())
                words, vecs, at = [], [], 0
                for _ in range(n):
                    stop = data.index(b" ", at)
                    words.append(data[at:stop].decode("utf-8", "replace").lstrip("\n"))
                    vecs.append(np.frombuffer(data, "<f4", dim, stop + 1).tolist())
                    at = stop + 1 + 4 * dim
                yield pd.DataFrame({"word": words, "vec": vecs})

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "word string, vec array<float>")
    if vocabulary is not None:
        out = out.join(vocabulary.select("word").distinct(), "word", "left_semi")
    return out.withColumn("vec", F.concat("vec", F.array(F.lit(1.0).cast("float")))) if bias else out


def for_vocabulary(vectors: DataFrame, vocabulary: DataFrame, lowercase: bool = False) -> DataFrame:
    """(word, vec): vectors of the words of a vocabulary, by their lookup form."""
    v = vocabulary.select("word", vector_key(F.col("word"), lowercase).alias("key"))
    return v.join(vectors.select(F.col("word").alias("key"), "vec"), "key").select("word", "vec")


def merge(sources: list[tuple[DataFrame, int]], longest: int | None = None, draw: bool = False) -> DataFrame:
    """(word, vec): several sources one behind the other; a source that lacks a word gives zeros, or
    with `draw` numbers drawn from the word's hash. Vectors are cut to the `longest` first entries."""
    out = None
    for i, (df, dim) in enumerate(sources):
        part = df.select("word", F.col("vec").alias(f"v{i}"))
        out = part if out is None else out.join(part, "word", "full_outer")
    lacking = lambda i, dim: _drawn(F.concat(F.col("word"), F.lit(f"|{i}")), dim) if draw else F.array_repeat(F.lit(0.0).cast("float"), dim)
    filled = F.concat(*[F.coalesce(f"v{i}", lacking(i, dim)) for i, (_, dim) in enumerate(sources)])
    return out.select("word", (filled if longest is None else F.slice(filled, 1, longest)).alias("vec"))


def _drawn(word: Column, dim: int) -> Column:
    """Numbers between -1 and 1 that depend on the word alone."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: ((F.pmod(F.xxhash64(word, i), F.lit(2_000_001)) - 1_000_000) / 1_000_000).cast("float"))


def complete(vectors: DataFrame, vocabulary: DataFrame, dim: int) -> DataFrame:
    """Adds vectors for words without one, drawn from the word's hash, so they are always the same."""
    missing = vocabulary.select("word").distinct().join(vectors.select("word"), "word", "left_anti")
    return vectors.select("word", "vec").unionByName(missing.select("word", _drawn(F.col("word"), dim).alias("vec")))


def misses(tokens: DataFrame, vectors: DataFrame, top: int = 50) -> DataFrame:
    """The most frequent words without a vector: a top-k report."""
    c = tokens.join(vectors.select("word").distinct(), "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "word").limit(top)
