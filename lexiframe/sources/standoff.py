"""Stand-off corpora in XML: a text file beside layers of regions, nodes, edges and annotations.

Files are parsed whole by the workers into one row per object; layers are then joins on ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = "{http://www.w3.org/XML/1998/namespace}id"
OBJECTS = "doc string, layer string, kind string, id string, start int, stop int, targets array<string>, from_id string, to_id string, label string, ref string, features map<string,string>"

# Labels of the entity layer as short types; all others are outside.
ENTITY_TYPES = {"location": "LOC", "person": "PER", "org": "ORG", "date": "MISC"}


def objects_of(content: bytes) -> list[dict]:
    """The objects of one layer file; a file that is no XML has none."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return []
    out: list[dict] = []
    for e in root.iter():
        tag = e.tag.rsplit("}", 1)[-1]
        if tag == "region":
            a = (e.get("anchors") or "").split()
            if len(a) == 2 and all(x.isdigit() for x in a):
                out.append({"kind": "region", "id": e.get(_ID), "start": int(a[0]), "stop": int(a[1])})
        elif tag == "node":
            links = [x for x in e if x.tag.rsplit("}", 1)[-1] == "link"]
            out.append({"kind": "node", "id": e.get(_ID), "targets": (links[0].get("targets") or "").split() if links else []})
        elif tag == "edge":
            out.append({"kind": "edge", "id": e.get(_ID), "from_id": e.get("from"), "to_id": e.get("to")})
        elif tag == "a":
            fs = {x.get("name"): x.get("value") or "".join(x.itertext()) for x in e.iter() if x.tag.rsplit("}", 1)[-1] == "f" and x.get("name")}
            out.append({"kind": "annotation", "id": e.get(_ID), "label": e.get("label"), "ref": e.get("ref"), "features": fs})
    return out


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, source, text) of all .txt files below a path; doc is the file's path without its ending."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    return t.select(F.regexp_replace(file, r"\.txt$", "").alias("doc"), file.alias("source"), F.col("value").alias("text"))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Rows of OBJECTS of all layer files doc-layer.xml below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-*.xml").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [c.split(" ")[0] for c in OBJECTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"]):
                doc, _, layer = path_.rpartition(".xml")[0].rpartition("-")
                rows = [{"doc": doc, "layer": layer, **o} for o in objects_of(bytes(content))]
                df = pd.DataFrame(rows, columns=names)
                for c in ("start", "stop"):
                    df[c] = df[c].astype("Int32")
                yield df.astype(object).where(df.notna(), None)

    return files.mapInPandas(run, OBJECTS)


def regions(o: DataFrame, layer: str) -> DataFrame:
    """(doc, begin, end, id) of a layer's regions: sentences `s`, segments `seg`."""
    return o.where((F.col("layer") == layer) & (F.col("kind") == "region")).select("doc", F.col("start").alias("begin"), F.col("stop").alias("end"), "id")


def tag_of(features: Column) -> Column:
    """The part of speech of an annotation: `msd`, else URL for web addresses, else `categor`, else UNK."""
    get = lambda k: F.try_element_at(features, F.lit(k))
    return F.coalesce(get("msd"), F.when(get("kind") == "urlAddress", "URL"), get("categor"), F.lit("UNK"))


def tags(o: DataFrame) -> DataFrame:
    """(doc, begin, end, id, tag): each tag over the segments that its node targets."""
    seg = regions(o, "seg").select("doc", F.col("id").alias("target"), "begin", "end")
    n = o.where("layer = 'penn' and kind = 'node'").select("doc", "id", F.explode("targets").alias("target"))
    span = n.join(seg, ["doc", "target"]).groupBy("doc", "id").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    a = o.where("layer = 'penn' and kind = 'annotation'").select("doc", F.col("ref").alias("id"), tag_of(F.col("features")).alias("tag"))
    return a.join(span, ["doc", "id"]).select("doc", "begin", "end", "id", "tag")


def entities(o: DataFrame) -> DataFrame:
    """(doc, begin, end, id, label): each entity over the tagged tokens that its node's edges lead to."""
    t = tags(o).select("doc", F.col("id").alias("to_id"), "begin", "end").distinct()
    e = o.where("layer = 'ne' and kind = 'edge'").select("doc", F.col("from_id").alias("id"), "to_id")
    span = e.join(t, ["doc", "to_id"]).groupBy("doc", "id").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    a = o.where("layer = 'ne' and kind = 'annotation'").select("doc", F.col("ref").alias("id"), "label")
    return a.join(span, ["doc", "id"]).select("doc", "begin", "end", "id", "label")


def short_type(label: Column) -> Column:
    out = None
    for k, v in ENTITY_TYPES.items():
        out = F.when(label == k, v) if out is None else out.when(label == k, v)
    return out.otherwise("O")


def aligned(o: DataFrame, text: DataFrame) -> DataFrame:
    """(doc, sent_begin, pos, begin, end, token, tag, bio): the tagged tokens of every sentence region
    with B-, I- and O labels of the entities that cover them, in short types."""
    from pyspark.sql import Window

    from lexiframe.operators import layers

    t = layers.within(tags(o), regions(o, "s"), "doc").withColumnRenamed("outer_begin", "sent_begin")
    e = entities(o).where(short_type(F.col("label")) != "O").select("doc", F.col("begin"), F.col("end"), F.col("id").alias("entity"), short_type(F.col("label")).alias("type"))
    c = layers.covering(t.select("doc", "begin", "end").distinct(), e.select("doc", "begin", "end").distinct(), "doc")
    marks = c.join(e.select("doc", F.col("begin").alias("outer_begin"), F.col("end").alias("outer_end"), "type"), ["doc", "outer_begin", "outer_end"])
    # of several entities over a token the one that begins first, then the longest
    best = marks.groupBy("doc", "begin", "end").agg(F.min_by(F.struct("outer_begin", "type"), F.struct("outer_begin", -F.col("outer_end"), F.col("type"))).alias("m"))
    j = t.join(best, ["doc", "begin", "end"], "left").join(text.select("doc", "text"), "doc")
    bio = F.when(F.col("m").isNull(), "O").when(F.col("begin") == F.col("m.outer_begin"), F.concat(F.lit("B-"), "m.type")).otherwise(F.concat(F.lit("I-"), "m.type"))
    pos = F.row_number().over(Window.partitionBy("doc", "sent_begin").orderBy("begin", "end")) - 1
    return j.select("doc", "sent_begin", pos.alias("pos"), "begin", "end", F.expr("substring(text, begin + 1, end - begin)").alias("token"), "tag", bio.alias("bio"))
