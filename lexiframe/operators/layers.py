"""Standoff layers: rows (doc_id, begin, end, ...) over a text, and their algebra.

Offsets are zero-based, half-open and count code points. A null text has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.session import spread

#: Java's white space, written out so that other engines read the class alike.
WS = r" \t\n\x0B\f\r"
SENTENCE = rf"[^{WS}.!?][^.!?]++[.!?]|[^{WS}.!?]++\z"
#: A last stretch without a final mark, up to its last word: stepped over at once, not start by start.
UNFINISHED = rf"[^{WS}.!?][^.!?]*[{WS}](?=[^{WS}.!?]*+\z)"
TOKEN = r"\p{L}+|\p{P}+|\p{N}+"


def pieces(df: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, begin, end, piece): a text cut by a pattern whose alternatives cover every character.

    The offsets are running sums of the pieces' lengths within a text. The texts are shuffled by
    their id before they are cut, so what moves is the input and not the pieces.
    """
    found = spread(df.select(id_col, text_col), id_col).select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("i", "piece"))
    w = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)).cast("int")
    return found.withColumn("begin", begin).withColumn("end", (F.col("begin") + F.length("piece")).cast("int"))


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, begin, end, sentence) of the pattern segmenter: from a character that is neither space
    nor a final mark to the next final mark or the end of the text."""
    p = pieces(df, rf"{SENTENCE}|{UNFINISHED}|(?s:.)", id_col, text_col)
    last = F.col("end") == F.max("end").over(Window.partitionBy(id_col))
    p = p.withColumn("last", last).where(~F.col("piece").rlike(rf"[{WS}]$") & ((F.length("piece") > 1) | F.col("last") & ~F.col("piece").isin(".", "!", "?")))
    return p.select(id_col, "begin", "end", F.col("piece").alias("sentence"))


def tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, begin, end, token): runs of letters, of punctuation and of digits."""
    p = pieces(df, rf"{TOKEN}|[^\p{{L}}\p{{P}}\p{{N}}]+", id_col, text_col)
    return p.where(F.col("piece").rlike(r"^[\p{L}\p{P}\p{N}]")).select(id_col, "begin", "end", F.col("piece").alias("token"))


def matches(df: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, begin, end, token): all matches of a pattern that matches no empty text, with their offsets
    in the text. Each text's matches are marked with two characters that it doesn't hold."""
    free = F.filter(F.lit([chr(c) for c in range(0xF8C0, 0xF900)]), lambda c: ~F.contains(text_col, c))
    t = df.where(F.col(text_col).isNotNull()).select(id_col, text_col, free.alias("free"))
    a = F.coalesce(F.get("free", 0), F.raise_error(F.lit("a text holds all marks")).cast("string"))
    z = F.coalesce(F.get("free", 1), F.raise_error(F.lit("a text holds all marks")).cast("string"))
    marked = F.regexp_replace(F.col(text_col), F.lit(f"({pattern})"), F.concat("a", F.lit("$1"), "z"))
    t = t.select(id_col, text_col, a.alias("a"), z.alias("z")).select(id_col, "a", marked.alias("text"), F.concat("a", F.lit("[^"), "z", F.lit("]*"), "z", F.lit("|[^"), "a", F.lit("]+")).alias("cut"))
    found = spread(t, id_col).select(id_col, "a", F.posexplode(F.regexp_extract_all("text", F.col("cut"), F.lit(0))).alias("i", "piece"))
    hit = F.col("piece").startswith(F.col("a"))
    w = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("piece") - F.when(hit, 2).otherwise(0)
    p = found.withColumn("begin", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("int")).where(hit)
    token = F.substring(F.col("piece"), F.lit(2), F.length("piece") - 2)
    return p.select(id_col, "begin", (F.col("begin") + F.length(token)).alias("end"), token.alias("token"))


def lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, begin, end, line): stretches that end after a run of line feeds. One of a single
    character is dropped; the rest behind the last line feed always comes out, though it be empty."""
    p = pieces(df.where(F.length(text_col) > 0), r"[^\n]*\n+|[^\n]+", id_col, text_col)
    kept = p.where((F.length("piece") > 1) | ~F.col("piece").endswith("\n")).select(id_col, "begin", "end", F.col("piece").alias("line"))
    at = F.length(text_col).cast("int")
    tail = df.where(F.col(text_col).isNotNull() & ((F.length(text_col) == 0) | F.col(text_col).endswith("\n")))
    return kept.unionByName(tail.select(id_col, at.alias("begin"), at.alias("end"), F.lit("").alias("line")))


def within(inner: DataFrame, outer: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of inner with outer_begin and outer_end of the outer region that covers them.

    Where outer regions don't overlap, the one that could cover a row is the last to begin at or before
    it: one sort per text instead of a join of all pairs. Rows that none covers are left out. For
    regions that overlap see covering.
    """
    o = outer.select(id_col, F.col("begin").alias("at"), F.lit(0).alias("side"), F.struct("begin", "end").alias("o"), F.lit(None).cast(inner.select(F.struct(*inner.columns)).schema[0].dataType).alias("r"))
    i = inner.select(id_col, F.col("begin").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<begin:int,end:int>").alias("o"), F.struct(*inner.columns).alias("r"))
    w = Window.partitionBy(id_col).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = o.unionByName(i).withColumn("cover", F.last("o", ignorenulls=True).over(w))
    return both.where((F.col("side") == 1) & (F.col("cover.end") >= F.col("r.end"))).select("r.*", F.col("cover.begin").alias("outer_begin"), F.col("cover.end").alias("outer_end"))


def covering(inner: DataFrame, outer: DataFrame, id_col: str = "doc_id", cell: int = 256) -> DataFrame:
    """Rows of inner with outer_begin and outer_end of every outer region that covers them; outer
    regions may overlap, and equal ones count once.

    A region stands in each cell of offsets it touches, a row only in the cell of its begin, so both
    sides meet by an equi-join on (id, cell) and no pair is found twice.
    """
    o = outer.select(id_col, F.col("begin").alias("outer_begin"), F.col("end").alias("outer_end")).distinct()
    o = o.select("*", F.explode(F.sequence(F.floor(F.col("outer_begin") / cell), F.floor(F.col("outer_end") / cell))).alias("_cell"))
    i = inner.withColumn("_cell", F.floor(F.col("begin") / cell))
    return i.join(o, [id_col, "_cell"]).where("outer_begin <= begin and end <= outer_end").drop("_cell")


def nearest(regions: DataFrame, layer: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, begin, end, preceding_end, following_begin): for each region the nearest annotation of
    the layer that ends at or before it, and the nearest that begins at or after its end."""

    def side(at_region: str, at_layer: str, before: bool) -> DataFrame:
        r = regions.select(id_col, F.col(at_region).alias("at"), F.lit(1 if before else 0).alias("side"), "begin", "end", F.lit(None).cast("int").alias("hit"))
        a = layer.select(id_col, F.col(at_layer).alias("at"), F.lit(0 if before else 1).alias("side"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end"), F.col(at_layer).alias("hit"))
        order = Window.partitionBy(id_col).orderBy("at", "side")
        if before:
            found = F.last("hit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        else:
            found = F.first("hit", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
        return r.unionByName(a).withColumn("found", found).where(F.col("begin").isNotNull()).select(id_col, "begin", "end", "found")

    p = side("begin", "end", True).withColumnRenamed("found", "preceding_end")
    f = side("end", "begin", False).withColumnRenamed("found", "following_begin")
    return p.join(f, [id_col, "begin", "end"])


def covered(layer: DataFrame, region_begin: int, region_end: int) -> DataFrame:
    """Annotations wholly inside one region, in order."""
    return layer.where((F.col("begin") >= region_begin) & (F.col("end") <= region_end)).orderBy("begin", "end")


def preceding(layer: DataFrame, region_begin: int) -> DataFrame:
    """Annotations that end at or before a region begins, the nearest first."""
    return layer.where(F.col("end") <= region_begin).orderBy(F.desc("end"), F.desc("begin"))


def following(layer: DataFrame, region_end: int) -> DataFrame:
    """Annotations that begin at or after a region ends, in order."""
    return layer.where(F.col("begin") >= region_end).orderBy("begin", "end")


def spanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the covered text to rows that carry the text."""
    return df.withColumn("covered", F.expr(f"substring({text_col}, begin + 1, end - begin)"))


def add_layer(slab: DataFrame, layer: DataFrame, name: str) -> DataFrame:
    """Appends a layer (doc_id, begin, end, payload) under a name to a long slab (doc_id, layer, begin, end, payload)."""
    return slab.unionByName(layer.select("doc_id", F.lit(name).alias("layer"), "begin", "end", "payload"))


def remove_layer(slab: DataFrame, name: str) -> DataFrame:
    return slab.where(F.col("layer") != name)


def has_layer(slab: DataFrame, name: str) -> Column:
    """Per document, as an aggregate over its rows."""
    return F.max(F.col("layer") == name)


def render(slab: DataFrame) -> DataFrame:
    """(doc_id, layer, rendered): a layer's annotations as text, in order."""
    item = F.format_string("%s(%d,%d)", "payload", "begin", "end")
    a = F.array_sort(F.collect_list(F.struct("begin", "end", item.alias("s"))))
    return slab.groupBy("doc_id", "layer").agg(F.array_join(F.transform(a, lambda x: x["s"]), " ").alias("rendered"))
