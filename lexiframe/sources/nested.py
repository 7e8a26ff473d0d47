"""Deeply nested stand-off records as flat tables (problem 7).

A body is parsed once into a VARIANT. Nested transforms attach the keys of the ancestors, flatten
joins the arrays of one kind into a column, and one inline per target table emits rows: no shuffle but the one
that drops redelivered records. Nodes stand in nodes to any depth: LEVELS levels are unrolled in one
projection, and records that go deeper are carried on from there until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.session import cut, spread

#: Levels of nodes that one projection unrolls.
LEVELS = 6

_V = "variant"
# What is read of each object; the rest of an object is not touched.
LAYER = "struct<id:string,type:string,regions:variant,nodes:variant,annotations:variant,edges:variant>"
NODE = "struct<id:string,targets:variant,annotations:variant,nodes:variant>"
ANNOTATION = "struct<id:string,label:string,ref:string,features:variant>"
REGION = "struct<id:string,start:string,end:string,anchors:variant>"
EDGE = "struct<id:string,from:string,to:string>"
FEATURE = "struct<name:string,value:variant>"


def _items(v: Column, kind: str) -> Column:
    """The objects of an array, or the one object written in its place, as structs; none for null
    and scalars. Elements that are no objects are passed over."""
    whole = F.try_variant_get(v, "$", f"array<{kind}>")
    single = F.try_variant_get(v, "$", kind)
    odd = F.transform(F.try_variant_get(v, "$", f"array<{_V}>"), lambda x: F.try_variant_get(x, "$", kind))
    found = F.coalesce(whole, F.when(single.isNotNull(), F.array(single)), odd, F.array().cast(f"array<{kind}>"))
    return F.filter(found, lambda x: x.isNotNull())


def feature_items(v: Column) -> Column:
    """ARRAY<STRUCT<name, value>> of features in any shape: an object of names, an array of
    name-value objects, one such object, or any of them under the key `f`."""
    m = F.try_variant_get(v, "$", "map<string,variant>")
    keys = F.map_keys(m)
    under = F.try_variant_get(v, "$.f", _V)
    plain = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    as_pair = (F.size(m) == 2) & F.array_contains(keys, "name") & F.array_contains(keys, "value")
    as_f = (F.size(m) == 1) & F.array_contains(keys, "f") & (F.try_variant_get(under, "$", f"array<{_V}>").isNotNull() | F.try_variant_get(under, "$", FEATURE).isNotNull())
    none = F.array().cast(f"array<{FEATURE}>")
    return F.when(m.isNull(), _items(v, FEATURE)).when(as_f, _items(under, FEATURE)).when(as_pair, _items(v, FEATURE)).otherwise(F.coalesce(plain, none))


def _nested(parents: Column, of, kind: str) -> Column:
    """Objects that `of` reads from each (layer, parent, o), with their layer and parent."""

    def children(p: Column) -> Column:
        return F.transform(_items(of(p["o"]), kind), lambda c: F.struct(p["layer"].alias("layer"), p["o"]["id"].alias("parent"), c.alias("o")))

    return F.flatten(F.transform(parents, children))


def _records(df: DataFrame) -> DataFrame:
    one = spread(df.where("rec_id is not null").select("rec_id", "body"), "rec_id").dropDuplicates(["rec_id"])
    v = one.select("rec_id", F.try_parse_json(F.when(F.trim("body") != "", F.col("body"))).alias("root"))
    doc = F.try_variant_get("root", "$.doc", "string")
    layers = F.transform(_items(F.try_variant_get("root", "$.layers", _V), LAYER), lambda x: F.struct(x["id"].alias("layer"), doc.alias("parent"), x.alias("o")))
    return v.where("root is not null").select("rec_id", layers.alias("layers")).where(F.size("layers") > 0)


def _rows(items: Column, a=None, b=None, data=None) -> Column:
    """Rows of one kind: the texts and the variant of each object that the kind has."""

    def row(x: Column) -> Column:
        o = x["o"]
        more = [o[name].alias(to) for name, to in ((a, "a"), (b, "b"), (data, "data")) if name]
        return F.struct(x["layer"].alias("layer"), x["parent"].alias("parent"), o["id"].alias("id"), *more)

    return F.transform(items, row)


KINDS = ("layer", "region", "node", "annotation", "edge")


class Objects:
    """The objects of all records, an array column per kind and record; a table of one kind is one
    inline of its column, and reads no other."""

    def __init__(self, parts: list[DataFrame]):
        self.parts = parts

    def of(self, kind: str) -> DataFrame:
        """(rec_id, layer, parent, id, ...) with what the objects stand in as parent.

        layer: a = type; region: a = start, b = end, data = anchors; node: data = targets; annotation:
        a = label, b = ref, data = features; edge: a = from, b = to.
        """
        out = None
        for p in self.parts:
            if kind in p.columns:
                rows = p.select("rec_id", F.inline(kind))
                out = rows if out is None else out.unionByName(rows)
        return out


def objects(df: DataFrame, kinds: tuple[str, ...] = KINDS) -> Objects:
    """The objects of the kinds that are asked for.

    A record counts once however often it is delivered; null, blank, broken and empty bodies and
    those without layers give no rows. Other columns of df are not read.
    """
    parts: list[DataFrame] = []
    level = _records(df)
    first = True
    deep = "node" in kinds or "annotation" in kinds
    while True:
        made: dict[str, Column] = {}
        if deep:
            if first:
                level = level.withColumn("n0", _nested(F.col("layers"), lambda o: o["nodes"], NODE))
            for i in range(LEVELS):
                level = level.withColumn(f"n{i + 1}", _nested(F.col(f"n{i}"), lambda o: o["nodes"], NODE))
            level = level.withColumn("nodes", F.concat(*[F.col(f"n{i}") for i in range(LEVELS)]))
            made["node"] = _rows(F.col("nodes"), data="targets")
            made["annotation"] = _rows(_nested(F.col("nodes"), lambda o: o["annotations"], ANNOTATION), "label", "ref", "features")
        if first:
            if deep:
                # an annotation of a layer stands in no node
                of_layer = _rows(_nested(F.col("layers"), lambda o: o["annotations"], ANNOTATION), "label", "ref", "features")
                made["annotation"] = F.concat(made["annotation"], F.transform(of_layer, lambda r: r.withField("parent", F.lit(None).cast("string"))))
            made["layer"] = _rows(F.col("layers"), "type")
            made["region"] = _rows(_nested(F.col("layers"), lambda o: o["regions"], REGION), "start", "end", "anchors")
            made["edge"] = _rows(_nested(F.col("layers"), lambda o: o["edges"], EDGE), "from", "to")
        rest = [F.col(f"n{LEVELS}").alias("rest")] if deep else []
        done = cut(level.select("rec_id", *[made[k].alias(k) for k in kinds if k in made], *rest))
        parts.append(done)
        if not deep or (deeper := done.where(F.size("rest") > 0)).isEmpty():
            return Objects(parts)
        level, first = deeper.select("rec_id", F.col("rest").alias("n0")), False


def _texts(data: Column) -> Column:
    """An array of texts, or one text of texts parted by spaces."""
    return F.coalesce(F.try_variant_get(data, "$", "array<string>"), F.split(F.trim(F.try_variant_get(data, "$", "string")), r"\s+"), F.array().cast("array<string>"))


def layers(o: Objects) -> DataFrame:
    return o.of("layer").select("rec_id", F.col("id").alias("layer_id"), F.col("parent").alias("doc"), F.col("a").alias("type"))


def regions(o: Objects) -> DataFrame:
    """start and end from numbers, digit texts, or `anchors` as an array or a text of two numbers."""
    at = lambda c, i: F.coalesce(F.col(c), F.try_element_at(_texts(F.col("data")), F.lit(i))).try_cast("int")
    return o.of("region").select("rec_id", "layer", F.col("id").alias("region_id"), at("a", 1).alias("start"), at("b", 2).alias("end"))


def nodes(o: Objects) -> DataFrame:
    return o.of("node").select("rec_id", "layer", "parent", F.col("id").alias("node_id"), _texts(F.col("data")).alias("targets"))


def annotations(o: Objects) -> DataFrame:
    """ref: the annotation's own when given and not empty, else the node it stands in."""
    ref = F.when(F.col("b") != "", F.col("b")).otherwise(F.col("parent"))
    return o.of("annotation").select("rec_id", "layer", ref.alias("ref"), F.col("id").alias("annotation_id"), F.col("a").alias("label"))


def features(o: Objects) -> DataFrame:
    a = o.of("annotation").select("rec_id", F.col("id").alias("annotation_id"), F.inline(feature_items(F.col("data"))))
    return a.select("rec_id", "annotation_id", "name", F.to_json("value").alias("value_json"))


def edges(o: Objects) -> DataFrame:
    return o.of("edge").select("rec_id", "layer", F.col("id").alias("edge_id"), F.col("a").alias("from_id"), F.col("b").alias("to_id"))


def links(df: DataFrame) -> DataFrame:
    """(rec_id, obj_kind, child_id, parent_id): one row per object of each record."""

    def row(kind: str, child: Column, parent: Column) -> Column:
        return F.struct(F.lit(kind).alias("obj_kind"), child.alias("child_id"), parent.alias("parent_id"))

    def parent_of(kind: str, x: Column) -> Column:
        if kind == "edge":
            return x["a"]
        return F.when(x["b"] != "", x["b"]).otherwise(x["parent"]) if kind == "annotation" else x["parent"]

    def own_rows(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: row(kind, x["id"], parent_of(kind, x)))

    out = None
    for p in objects(df).parts:
        here = [k for k in KINDS if k in p.columns]
        own = [own_rows(k) for k in here]
        named = F.flatten(F.transform("annotation", lambda x: F.transform(feature_items(x["data"]), lambda f: row("feature", f["name"], x["id"]))))
        rows = p.select("rec_id", F.inline(F.concat(*own, named)))
        out = rows if out is None else out.unionByName(rows)
    return out
