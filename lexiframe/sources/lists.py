"""Line-based resources: gazetteers, word clusters, morphology, weights, grammars; a store of models."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def gazetteer(lines: DataFrame, col: str = "value") -> DataFrame:
    """(type, words) of lines `TYPE token token ...`; lines without a token are passed over."""
    p = F.filter(F.split(F.trim(col), r"\s+"), lambda x: x != "")
    return lines.select(p.alias("p")).where(F.size("p") > 1).select(F.col("p")[0].alias("type"), F.slice("p", 2, F.size("p") - 1).alias("words"))


def clusters(lines: DataFrame, col: str = "value", more_than: int = 1) -> DataFrame:
    """(word, cluster) of lines `cluster <tab> word <tab> count` with a count above more_than."""
    p = F.split(F.col(col), "\t")
    df = lines.select(p[1].alias("word"), p[0].alias("cluster"), F.get(p, 2).try_cast("bigint").alias("n")).where(F.col("n") > more_than)
    return df.groupBy("word").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("cluster"))


def with_digit_forms(df: DataFrame) -> DataFrame:
    """Each word and, where it has digits, the form with 1 for each of them; a form that several words
    share gets the smallest cluster, a word of its own keeps its own."""
    forms = F.array_distinct(F.array(F.struct(F.lit(0).alias("made"), F.col("word").alias("w")), F.struct(F.lit(1).alias("made"), F.regexp_replace("word", r"\d", "1").alias("w"))))
    x = df.select("cluster", F.explode(forms).alias("x"))
    return x.groupBy(F.col("x.w").alias("word")).agg(F.min_by("cluster", F.struct("x.made", "cluster")).alias("cluster"))


def cluster_prefixes(cluster: Column, sizes: tuple[int, ...] = (7, 11, 13)) -> Column:
    """ARRAY<STRING> of a cluster's prefixes at those lengths; shorter clusters stand whole, once."""
    return F.array_distinct(F.array(*[F.left(cluster, F.lit(n)) for n in sizes]))


def morphology(lines: DataFrame, file_col: str = "file", line_col: str = "line_no", text_col: str = "text") -> DataFrame:
    """(key, pos, features): lines `word lemma features` in blank-line separated blocks; the key is the
    block's words, by which a sentence finds its block."""
    from lexiframe.sources import columns

    b = columns.blocks(lines, file_col, line_col, text_col).withColumn("p", F.split(F.trim(text_col), r"\s+"))
    w = Window.partitionBy(file_col, "block").orderBy(line_col)
    b = b.withColumn("pos", F.row_number().over(w) - 1)
    key = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("p")[0].alias("w"))).over(Window.partitionBy(file_col, "block"))), lambda x: x["w"]), " ")
    return b.select(key.alias("key"), "pos", F.array(F.concat(F.lit("lem="), F.get("p", 1))).alias("features")).distinct()


def morphology_blocks(blocks: DataFrame, lines_col: str = "lines") -> DataFrame:
    """(key, entries ARRAY<STRUCT<pos, features>>) of rows that hold the lines of one whole block: the rows
    of morphology() by key."""
    p = F.transform(F.filter(lines_col, lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), r"\s+"))
    b = blocks.select(p.alias("p")).where(F.size("p") > 0)
    entries = F.transform("p", lambda x, i: F.struct(i.alias("pos"), F.array(F.concat(F.lit("lem="), F.get(x, 1))).alias("features")))
    b = b.select(F.array_join(F.transform("p", lambda x: x[0]), " ").alias("key"), entries.alias("entries"))
    return b.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("entries"))).alias("entries"))


def write_weights(weights: DataFrame, path: str, least: float = 1e-4) -> None:
    """feature <tab> weight, compressed; weights near zero are left out."""
    w = weights.where(F.abs("weight") > least).select(F.concat_ws("\t", "feature", F.col("weight").cast("string")).alias("value"))
    w.write.mode("overwrite").option("compression", "gzip").text(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    p = F.regexp_extract("value", r"(?s)^(.*)\t([^\t]*)$", 1), F.regexp_extract("value", r"\t([^\t]*)$", 1).try_cast("double")
    return spark.read.text(path).select(p[0].alias("feature"), p[1].alias("weight")).where("weight is not null")


def write_grammar(rules: DataFrame, path: str) -> None:
    """Rules (kind, parent, children, logp) as text, one per line in one order: `parent -> children score`."""
    r = rules.orderBy("kind", "parent", "children").select(F.concat_ws(" ", "kind", F.when(F.col("parent") == "", "*").otherwise(F.col("parent")), F.lit("->"), "children", F.format_string("%.6f", "logp")).alias("value"))
    r.coalesce(1).write.mode("overwrite").text(path)  # as many lines as the grammar has rules


def read_grammar(spark: SparkSession, path: str) -> DataFrame:
    m = lambda i: F.regexp_extract("value", r"^(\S+) (\S+) -> (.*) (\S+)$", i)
    return spark.read.text(path).select(m(1).alias("kind"), F.when(m(2) == "*", "").otherwise(m(2)).alias("parent"), m(3).alias("children"), m(4).try_cast("double").alias("logp"))


def signature(rules: DataFrame) -> DataFrame:
    """(md5) of a grammar: the same for the same rules, whatever their order."""
    line = F.concat_ws(" ", "kind", "parent", "children", F.format_string("%.6f", "logp"))
    return rules.agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("md5"))


def state_rules(binary: DataFrame, unary: DataFrame, least: float = -12.0) -> DataFrame:
    """(kind, parent, children, logp) of lines `A_0 B_1 C_0 p` and `A_0 B_1 p` of a grammar whose labels
    have numbered substates; rules of a log score below `least` are left out, ROOT is read as TOP."""
    name = lambda c: F.regexp_replace(F.regexp_replace(F.when(c.startswith("ROOT"), "TOP_0").otherwise(c), r"PRT\|ADVP_[0-9]*", "PRT_0"), "ROOT", "TOP")

    def rows(df: DataFrame, n: int, kind: str) -> DataFrame:
        p = F.split(F.trim("value"), r"\s+")
        s = df.select(p.alias("p")).where(F.size("p") == n + 1)
        s = s.select(F.lit(kind).alias("kind"), name(F.col("p")[0]).alias("parent"), F.concat_ws(" ", *[name(F.col("p")[i]) for i in range(1, n)]).alias("children"), F.log(F.col("p")[n].try_cast("double")).alias("logp"))
        return s.where(F.col("logp") >= least)

    return rows(binary, 3, "binary").unionByName(rows(unary, 2, "unary"))


def project_states(rules: DataFrame) -> DataFrame:
    """Substate rules by the plain rules they refine: (kind, parent, children, n, best)."""
    plain = lambda c: F.regexp_replace(c, r"_[0-9]+", "")
    return rules.groupBy("kind", plain(F.col("parent")).alias("parent"), plain(F.col("children")).alias("children")).agg(F.count(F.lit(1)).alias("n"), F.max("logp").alias("best"))


class ModelStore:
    """Models as folders of tables with a small description, found by what they can do and for which
    language. A model is written aside and renamed, so a half-written one is never found."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, p: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, name: str, does: str, language: str, tables: dict[str, DataFrame], **about) -> None:
        aside = f"{self.path}/.{uuid.uuid4().hex}"
        for k, df in tables.items():
            df.write.parquet(f"{aside}/{k}")
        fs, p = self._fs(f"{aside}/about.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"name": name, "does": does, "language": language, "tables": sorted(tables), **about}).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/{name}")
        fs.delete(final, True)
        if not fs.rename(self._fs(aside)[1], final):
            raise OSError(f"could not place {name}")

    def about(self) -> list[dict]:
        fs, p = self._fs(self.path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        return [json.loads(self.spark.read.text(f"{self.path}/{n}/about.json", wholetext=True).first()[0]) for n in names if not n.startswith(".")]

    def find(self, does: str, language: str | None = None) -> dict | None:
        """The first model by name that does this, for the language if one is named."""
        return next((a for a in self.about() if a["does"] == does and language in (None, a["language"])), None)

    def load(self, name: str) -> dict[str, DataFrame]:
        said = next(a for a in self.about() if a["name"] == name)
        return {t: self.spark.read.parquet(f"{self.path}/{name}/{t}") for t in said["tables"]}
