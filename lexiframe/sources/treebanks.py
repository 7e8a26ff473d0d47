"""Treebanks in files: bracketed trees by layout, portions, processing, and tree sinks.

A source gives (file, i, split, tree): i is the tree's place in its file, split its portion or null.
Files are read whole by the workers, as trees run over several lines, one task per group of files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiframe.functions.words import buckwalter_to_arabic
from lexiframe.operators import trees

_PIECE = re.compile(r"[()]|[^()]+")
SCHEMA = "file string, i int, tree string"


def pieces(text: str) -> list[str]:
    """The outermost bracketings of a text, one after the other; what stands outside is passed over."""
    out, depth, now = [], 0, []
    for m in _PIECE.finditer(text):
        t = m[0]
        if t == "(":
            depth += 1
        if depth:
            now.append(t)
        if t == ")" and depth:
            depth -= 1
            if not depth:
                out.append("".join(now))
                now = []
    return out


def read(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, encoding: str = "utf-8") -> DataFrame:
    """(file, i, tree) of all files below a path; empty files give no rows."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                found = pieces(bytes(content).decode(encoding, "replace"))
                yield pd.DataFrame({"file": file, "i": range(len(found)), "tree": found}).astype({"i": "int32"})

    return reader.load(path).select("path", "content").mapInPandas(run, SCHEMA)


def penn_split(file: Column) -> Column:
    """Sections 02 to 21 are train, 22 dev, 23 test; others are in no portion."""
    section = F.regexp_extract(file, r"/([0-9]{2})/[^/]*$", 1).try_cast("int")
    return F.when(section.between(2, 21), "train").when(section == 22, "dev").when(section == 23, "test")


def chinese_split(file: Column) -> Column:
    """File numbers 1 to 270 and 400 to 1151 are train, 301 to 325 dev, 271 to 300 test."""
    n = F.regexp_extract(file, r"chtb_([0-9]+)\.[^/]*$", 1).try_cast("int")
    return F.when(n.between(1, 270) | n.between(400, 1151), "train").when(n.between(301, 325), "dev").when(n.between(271, 300), "test")


def negra_split(file: Column) -> Column:
    return F.when(file.endswith("negra_1.mrg"), "train").when(file.endswith("negra_2.mrg"), "dev").when(file.endswith("negra_3.mrg"), "test")


def folder_split(file: Column) -> Column:
    """By the name of a folder or file: train (also train5k), dev, test."""
    return F.regexp_extract(file, r"/(train|dev|test)(?:5k)?(?:/|\.[^/]*$)", 1)


#: Layouts: how files are found and encoded, and which portion a file is in.
LAYOUTS = {
    "penn": ("*", "utf-8", penn_split),
    "chinese": ("*.mrg", "utf-8", chinese_split),
    "negra": ("negra_*.mrg", "iso8859-1", negra_split),
    "simple": ("*.txt", "utf-8", folder_split),
    "spmrl": ("*.ptb", "utf-8", folder_split),
    "spmrl5k": ("*.ptb", "utf-8", folder_split),
    "meta": ("*.parse", "utf-8", folder_split),
}


def treebank(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(file, i, split, tree) of a folder in one of LAYOUTS; files in no portion are left out."""
    glob, encoding, split = LAYOUTS[layout]
    df = read(spark, path, glob, encoding=encoding).withColumn("split", split(F.col("file")))
    if layout == "spmrl5k":
        df = df.where(~F.col("file").contains("/train/"))
    elif layout == "spmrl":  # the small training part stands in where there is no other
        whole = df.where(F.col("file").contains("/train/")).limit(1).count() > 0
        df = df.where(~F.col("file").contains("/train5k/")) if whole else df
    return df.where("split <> ''").select("file", "i", "split", "tree")


def cut_by_order(df: DataFrame, share: float = 0.9, file_col: str = "file", order_col: str = "i") -> DataFrame:
    """Trees named train are cut by their order: the first `share` stay train, the rest is dev.

    Places are found from counts per file, so no window runs over all rows: a file's trees stand
    behind those of all files before it.
    """
    per = df.where("split = 'train'").groupBy(file_col).agg(F.count(F.lit(1)).alias("n"))
    # a row per file: few enough for one window
    before = per.select(file_col, (F.sum("n").over(Window.orderBy(file_col)) - F.col("n")).alias("before"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    j = df.join(before, file_col, "left").crossJoin(F.broadcast(total))  # total is one row
    place = F.row_number().over(Window.partitionBy(file_col).orderBy(order_col)) - 1 + F.col("before")
    j = j.withColumn("place", place)
    dev = (F.col("split") == "train") & (F.col("place") >= F.floor(F.col("total") * share))
    return j.withColumn("split", F.when(dev, "dev").otherwise(F.col("split"))).drop("before", "total", "place")


def processed(df: DataFrame, longest: int | None = None, dev_in_train: bool = False, first: int | None = None, debuckwalter: bool = False, head: str = "head", fold_unaries: bool = True) -> DataFrame:
    """(file, i, split, tree) ready for training: standardized, training trees without those of more
    than `longest` words, their unary chains folded, all binarized around the head (`head`, `left` or
    `right`). With dev_in_train the dev trees are training trees too; `first` takes so many of these,
    in order of file and place."""
    find = {"head": trees.head_child, "left": lambda t: 0, "right": lambda t: len(t[1]) - 1}[head]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, i, split, text in b.itertuples(index=False):
                t = trees.read(text)
                t = trees.standardize(t) if t else None
                if t is None:
                    continue
                n = len(trees.leaves(t))
                if split == "train" and longest is not None and n > longest:
                    continue
                if split == "train" and fold_unaries:
                    t = trees.collapse_unaries(t)
                rows.append((file, i, split, trees.render(trees.binarize(t, find))))
            yield pd.DataFrame(rows, columns=["file", "i", "split", "tree"])

    out = df
    if dev_in_train:
        out = out.unionByName(out.where("split = 'dev'").withColumn("split", F.lit("train")))
    if debuckwalter:
        words = F.regexp_extract_all("tree", F.lit(r"[^()\s]+(?=\))"), F.lit(0))
        parts = F.split("tree", r"[^()\s]+(?=\))", -1)
        turned = F.transform(words, buckwalter_to_arabic)
        out = out.withColumn("tree", F.array_join(F.flatten(F.zip_with(parts, turned, lambda p, w: F.array(F.coalesce(p, F.lit("")), F.coalesce(w, F.lit(""))))), ""))
    out = out.select("file", "i", "split", "tree").mapInPandas(run, "file string, i int, split string, tree string")
    if first is not None:
        train = out.where("split = 'train'").orderBy("file", "i").limit(first)
        out = train.unionByName(out.where("split <> 'train'"))
    return out


def write(df: DataFrame, path: str, tree_col: str = "tree", by: str | None = None) -> None:
    """One tree per line, rendered in one form; with `by` in a folder per value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = [trees.render(x) if (x := trees.read(s)) else None for s in b["value"]]
            yield b.assign(value=t).dropna(subset=["value"])

    keep = [F.col(tree_col).alias("value"), *([F.col(by).cast("string").alias(by)] if by else [])]
    out = df.select(*keep).mapInPandas(run, "value string" + (f", {by} string" if by else ""))
    w = out.write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def bucketed(pairs: DataFrame, width: int = 10, letters_only: bool = False) -> DataFrame:
    """Adds `bucket`, the length of the gold tree's sentence rounded down to a multiple of `width`, to
    pairs (gold, guess); with letters_only words without a letter or digit don't count."""
    words = F.regexp_extract_all("gold", F.lit(r"([^()\s]+)\)"), F.lit(1))
    n = F.size(F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]"))) if letters_only else F.size(words)
    return pairs.withColumn("bucket", (F.floor(n / width) * width).cast("int"))


def write_bucketed(pairs: DataFrame, path: str, width: int = 10, letters_only: bool = False) -> None:
    """Gold and guessed trees in folders side=gold|guess/bucket=n, one tree per line, in one order."""
    b = bucketed(pairs, width, letters_only)
    out = b.select("bucket", F.explode(F.create_map(F.lit("gold"), F.col("gold"), F.lit("guess"), F.col("guess"))).alias("side", "value"))
    out.write.mode("overwrite").partitionBy("side", "bucket").text(path)
