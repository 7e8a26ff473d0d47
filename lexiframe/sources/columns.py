"""Column corpora: blank-line separated blocks of lines, columns parted by blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(lines: DataFrame, file_col: str = "file", line_col: str = "line_no", text_col: str = "text") -> DataFrame:
    """Adds `block`: the running number of the blank-line separated block within each file; blank
    lines are left out."""
    blank = F.trim(text_col) == ""
    w = Window.partitionBy(file_col).orderBy(line_col)
    b = lines.withColumn("blank", blank).withColumn("new", (F.col("blank") & ~F.coalesce(F.lag("blank").over(w), F.lit(True))).cast("int"))
    return b.withColumn("block", F.sum("new").over(w).cast("int")).where(~F.col("blank")).drop("blank", "new")


def examples(lines: DataFrame, labelled: bool = True, file_col: str = "file", line_col: str = "line_no", text_col: str = "text") -> DataFrame:
    """(id, words, features, labels) per block: the first column is the word, the last the label,
    all before it are inputs; unlabelled corpora have inputs only. The id is file-block."""
    cols = F.split(F.trim(text_col), " +")
    inputs = F.slice(cols, 1, F.size(cols) - (1 if labelled else 0))
    item = F.struct(F.col(line_col).alias("at"), cols[0].alias("word"), inputs.alias("inputs"), F.when(F.lit(labelled), F.element_at(cols, -1)).alias("label"))
    g = blocks(lines, file_col, line_col, text_col).groupBy(file_col, "block").agg(F.array_sort(F.collect_list(item)).alias("a"))
    return g.select(F.concat_ws("-", file_col, "block").alias("id"), F.col("a.word").alias("words"), F.col("a.inputs").alias("inputs"), F.col("a.label").alias("labels"))


def block_examples(blocks: DataFrame, labelled: bool = True, lines_col: str = "lines") -> DataFrame:
    """(words, inputs, labels) of rows that hold the lines of one whole block: what examples() gives where
    the blocks are known, without a shuffle."""
    lines = F.transform(F.filter(lines_col, lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), " +"))
    b = blocks.select(lines.alias("cols")).where(F.size("cols") > 0)
    labels = F.transform("cols", lambda c: F.when(F.lit(labelled), F.element_at(c, -1)))
    inputs = F.transform("cols", lambda c: F.slice(c, 1, F.size(c) - (1 if labelled else 0)))
    return b.select(F.transform("cols", lambda c: c[0]).alias("words"), inputs.alias("inputs"), labels.alias("labels"))


def documents(lines: DataFrame, begin: str = "#begin", end: str = "#end", file_col: str = "file", line_col: str = "line_no", text_col: str = "text") -> DataFrame:
    """Adds `document`: the running number of the begin-end stretch; lines outside are left out."""
    w = Window.partitionBy(file_col).orderBy(line_col)
    starts, ends = F.sum(F.col(text_col).startswith(begin).cast("int")).over(w), F.sum(F.col(text_col).startswith(end).cast("int")).over(w)
    d = lines.withColumn("document", starts.cast("int")).withColumn("open", starts - ends)
    return d.where((F.col("open") == 1) & ~F.col(text_col).startswith(begin)).drop("open")


def heads(cols: Column) -> Column:
    """Head positions of dependency rows: column 7 counts from one, the root is 0."""
    return cols[6].cast("int") - 1


def bracket_spans(cells: DataFrame, by: list[str], pos_col: str = "pos", cell_col: str = "cell") -> DataFrame:
    """(…, label, begin, end) of star-bracket columns such as `(NP*`, `*`, `*)`.

    The n-th opening bracket of a depth closes with the n-th closing one of that depth.
    """
    ops = F.regexp_extract_all(F.col(cell_col), F.lit(r"\(([^()*]+)|(\))"), F.lit(0))
    e = cells.select(*by, pos_col, F.posexplode(ops).alias("k", "op"))
    w = Window.partitionBy(*by).orderBy(pos_col, "k")
    e = e.withColumn("is_open", F.col("op").startswith("("))
    e = e.withColumn("depth", F.sum(F.when(F.col("is_open"), 1).otherwise(-1)).over(w)).withColumn("level", F.when(F.col("is_open"), F.col("depth")).otherwise(F.col("depth") + 1))
    n = F.row_number().over(Window.partitionBy(*by, "level", "is_open").orderBy(pos_col, "k"))
    e = e.withColumn("n", n)
    o = e.where("is_open").select(*by, "level", "n", F.expr("substring(op, 2)").alias("label"), F.col(pos_col).alias("begin"))
    c = e.where("not is_open").select(*by, "level", "n", (F.col(pos_col) + 1).alias("end"))
    return o.join(c, [*by, "level", "n"]).select(*by, "label", "begin", "end")
