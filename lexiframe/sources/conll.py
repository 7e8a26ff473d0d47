"""Coreference-task column files: documents, words, trees, entities, arguments and coreference.

All layers come from the lines by splits, windows and joins; only the layers' brackets need the
n-th opening to meet the n-th closing one of its depth, which is two windows and a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiframe.sources import columns

# Columns of the format, counted from 0.
WORD, TAG, PARSE, LEMMA, FRAME, SPEAKER, NER, FIRST_ARGS = 3, 4, 5, 6, 7, 9, 10, 11


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) of text files: each file's lines numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "text"))


def tokens(df: DataFrame) -> DataFrame:
    """(doc_id, sent, pos, cols) of lines (file, line_no, text): documents are #begin-#end stretches,
    numbered per file; sentences blank-line separated blocks, numbered per document."""
    d = columns.documents(df).withColumn("doc_id", F.concat_ws("-", "file", F.col("document") - 1))
    b = columns.blocks(d.select("doc_id", "line_no", "text"), "doc_id")
    first = F.min("block").over(Window.partitionBy("doc_id"))
    pos = F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("line_no")) - 1
    return b.select("doc_id", (F.col("block") - first).cast("int").alias("sent"), pos.alias("pos"), F.split(F.trim("text"), r"\s+").alias("cols"))


BY = ["doc_id", "sent"]


def sentences(t: DataFrame) -> DataFrame:
    """(doc_id, sent, words, tags, lemmas, speaker, tree): the speaker is the first that is named;
    the tree is written from the parse column."""
    c = F.col("cols")
    leaf = F.concat(F.lit("("), c[TAG], F.lit(" "), c[WORD], F.lit(")"))
    item = F.struct("pos", c[WORD].alias("w"), c[TAG].alias("t"), c[LEMMA].alias("l"), c[SPEAKER].alias("s"), F.replace(c[PARSE], F.lit("*"), F.concat(F.lit(" "), leaf)).alias("p"))
    a = F.array_sort(F.collect_list(item))
    s = t.groupBy(*BY).agg(a.alias("a"))
    named = F.filter("a", lambda x: (x["s"] != "-") & x["s"].isNotNull())
    return s.select(*BY, F.col("a.w").alias("words"), F.col("a.t").alias("tags"), F.col("a.l").alias("lemmas"), F.get(named, 0)["s"].alias("speaker"), F.array_join("a.p", "").alias("tree"))


def entities(t: DataFrame) -> DataFrame:
    """(doc_id, sent, label, begin, end)."""
    return columns.bracket_spans(t.select(*BY, "pos", F.col("cols")[NER].alias("cell")), BY)


def arguments(t: DataFrame) -> DataFrame:
    """(doc_id, sent, frame, verb, sense, lemma, label, begin, end): arguments of every frame, the
    frame's column number counted from 0; its verb is the span labelled V, which must be one word."""
    c = t.select(*BY, "pos", "cols", F.explode(F.sequence(F.lit(FIRST_ARGS), F.greatest(F.size("cols") - 2, F.lit(FIRST_ARGS)))).alias("k")).where(F.col("k") < F.size("cols") - 1)
    cells = c.select(*BY, (F.col("k") - FIRST_ARGS).alias("frame"), "pos", F.get("cols", F.col("k")).alias("cell"))
    s = columns.bracket_spans(cells, [*BY, "frame"])
    at = t.select(*BY, F.col("pos").alias("verb"), F.col("cols")[FRAME].try_cast("int").alias("sense"), F.col("cols")[LEMMA].alias("lemma"))
    v = s.where("label = 'V' and end = begin + 1").select(*BY, "frame", F.col("begin").alias("verb")).join(at, [*BY, "verb"])
    return s.where("label <> 'V'").join(v, [*BY, "frame"]).select(*BY, "frame", "verb", "sense", "lemma", "label", "begin", "end")


def mentions(t: DataFrame) -> DataFrame:
    """(doc_id, sent, entity, begin, end) of the last column: `(3`, `3)`, `(3)`, parted by |. The
    mentions of one entity are nested: an end closes the entity's last open begin."""
    parts = t.select(*BY, "pos", F.posexplode(F.split(F.element_at("cols", -1), r"\|")).alias("k", "part")).where("part <> '-'")
    number = F.regexp_extract("part", r"([0-9]+)", 1).try_cast("int")
    both = F.concat(F.when(F.col("part").startswith("("), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.when(F.col("part").endswith(")"), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    e = parts.select(*BY, "pos", "k", number.alias("entity"), F.posexplode(both).alias("j", "step"))
    by = [*BY, "entity"]
    w = Window.partitionBy(*by).orderBy("pos", "k", "j")
    depth = F.sum("step").over(w)
    e = e.withColumn("level", depth + F.when(F.col("step") < 0, 1).otherwise(0))
    n = F.row_number().over(Window.partitionBy(*by, "level", "step").orderBy("pos", "k", "j"))
    e = e.withColumn("n", n)
    o = e.where("step > 0").select(*by, "level", "n", F.col("pos").alias("begin"))
    c = e.where("step < 0").select(*by, "level", "n", (F.col("pos") + 1).alias("end"))
    return o.join(c, [*by, "level", "n"]).select(*by, "begin", "end")


def without_embedded(args: DataFrame) -> DataFrame:
    """Arguments of a frame that lie in no longer argument of the same frame."""
    by = [*BY, "frame"]
    o = args.select(*by, F.col("begin").alias("ob"), F.col("end").alias("oe"))
    inside = args.join(o, by).where("ob <= begin and end <= oe and oe - ob > end - begin").select(*by, "label", "begin", "end").distinct()
    return args.join(inside, [*by, "label", "begin", "end"], "left_anti")


def argument_segments(args: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, sent, frame, label, begin, end) of frames' outermost arguments, with unit segments
    labelled O for the words outside; lengths (doc_id, sent, n)."""
    by = [*BY, "frame"]
    s = without_embedded(args).select(*by, "label", "begin", "end")
    words = args.select(*by).distinct().join(lengths, BY).select(*by, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    covered = s.select(*by, F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"))
    gaps = words.join(covered, [*by, "pos"], "left_anti").select(*by, F.lit("O").alias("label"), F.col("pos").alias("begin"), (F.col("pos") + 1).alias("end"))
    return s.unionByName(gaps)
