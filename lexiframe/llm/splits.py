"""Splits that keep related records together (problem 4).

Components come from random-mate contraction: in each round every vertex throws a coin; tails that
have a heads neighbour collapse into the smallest such neighbour, edges are renamed, loops and
repeats dropped, until no edge is left. The number of rounds grows with the logarithm of the number
of vertices and not with the graph's diameter. The renamings of all rounds are then unwound from
the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.session import cut, cut_counted, release

#: Hash buckets of the running total over components.
WEIGHT_BUCKETS = 1024


def links(sentences: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, between docids that share a section or a named speaker.

    A null docid has no edges; a null section and a speaker that is null, empty or `-` link nothing.
    Every key links its docids to their smallest one, so a key of n docids gives n - 1 edges.
    """
    base = sentences.where("docid is not null").select("docid", "section_id", F.col("annotations.speaker").alias("speaker"))
    keys = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("section_id").alias("key")),
        F.struct(F.lit(1).alias("kind"), F.when(~F.col("speaker").isin("", "-"), F.col("speaker")).alias("key")),
    )
    held = base.distinct().select("docid", F.explode(keys).alias("k")).where("k.key is not null").select("docid", "k.kind", "k.key").distinct()
    held = cut(held)
    least = held.groupBy("kind", "key").agg(F.min("docid").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return held.join(least, ["kind", "key"]).where("docid > v").select(F.col("docid").alias("u"), "v").distinct()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(vertex, root): for every vertex that has an edge (u, v), the vertex its component fell into."""
    edges, n = cut_counted(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mates: list[DataFrame] = []
    for r in range(max_rounds):
        if not n:
            break
        coin = lambda c, r=r: F.xxhash64(F.lit(r), c).bitwiseAND(1)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mate = both.where((coin(F.col("u")) == 0) & (coin(F.col("v")) == 1)).groupBy("u").agg(F.min("v").alias("p"))
        mate = cut(mate.withColumnRenamed("u", "x"))
        mates.append(mate)
        to_u = mate.select(F.col("x").alias("u"), F.col("p").alias("pu"))
        to_v = mate.select(F.col("x").alias("v"), F.col("p").alias("pv"))
        e = edges.join(to_u, "u", "left").join(to_v, "v", "left")
        e = e.select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v")).where("u <> v")
        new, n = cut_counted(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        release(edges)
        edges = new
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    spark = edges.sparkSession
    if not mates:
        return spark.createDataFrame([], f"vertex {edges.schema['u'].dataType.simpleString()}, root {edges.schema['u'].dataType.simpleString()}")
    # the renamings of several rounds are unwound in one plan; a table is written every few rounds
    label = mates[-1].select(F.col("x").alias("vertex"), F.col("p").alias("root"))
    for i, mate in enumerate(reversed(mates[:-1]), 1):
        up = label.select(F.col("vertex").alias("p"), "root")
        own = mate.join(up, "p", "left").select(F.col("x").alias("vertex"), F.coalesce("root", "p").alias("root"))
        label = own.unionByName(label)
        if i % 4 == 0 or i == len(mates) - 1:
            label = cut(label)
    # the roots themselves carry their own name
    roots = label.select(F.col("root").alias("vertex")).distinct()
    return label.unionByName(roots.withColumn("root", F.col("vertex")))


def groups(sentences: DataFrame) -> DataFrame:
    """(docid, group_docid): every docid with the smallest one, by code points, of all that must
    share its split. Null docids are left out; an empty table gives no row."""
    docs = sentences.where("docid is not null").select("docid").distinct()
    comp = components(links(sentences))
    least = comp.groupBy("root").agg(F.min("vertex").alias("group_docid"))
    named = comp.join(least, "root").select(F.col("vertex").alias("docid"), "group_docid")
    return docs.join(named, "docid", "left").select("docid", F.coalesce("group_docid", "docid").alias("group_docid"))


def assign(weights: DataFrame, proportions: dict[str, float], heavy_share: float = 0.001) -> DataFrame:
    """(group, split) for (group, weight): whole groups, as near the proportions as possible.

    Groups of at least heavy_share of all weight (at most 1 / heavy_share of them) are placed first,
    the heaviest first, each where most room is left; the light ones follow in the order of their
    hash by cumulative weight. The running total is taken within hash buckets and over the bucket
    totals, so no task holds all groups.
    """
    weights = cut(weights.select("group", F.col("weight").cast("double").alias("weight")))
    total = weights.agg(F.sum("weight")).first()[0] or 0.0
    room = {k: v * total / sum(proportions.values()) for k, v in proportions.items()}
    heavy = weights.where(F.col("weight") >= heavy_share * total).orderBy(F.desc("weight"), "group").collect() if total else []
    placed = []
    for g in heavy:
        split = max(room, key=lambda k: room[k])
        room[split] -= g["weight"]
        placed.append((g["group"], split))
    spark = weights.sparkSession
    kind = weights.schema["group"].dataType.simpleString()
    first = spark.createDataFrame(placed, f"group {kind}, split string")
    light = weights.where(F.col("weight") < heavy_share * total).withColumn("h", F.xxhash64("group"))
    light = light.withColumn("bucket", F.pmod("h", F.lit(WEIGHT_BUCKETS)).cast("int"))
    sums = {r["bucket"]: r["w"] for r in light.groupBy("bucket").agg(F.sum("weight").alias("w")).collect()}
    rest = sum(sums.values())
    before, at = [], 0.0
    for b in range(WEIGHT_BUCKETS):
        before.append(at)
        at += sums.get(b, 0.0)
    from pyspark.sql import Window

    run = F.sum("weight").over(Window.partitionBy("bucket").orderBy("h", "group").rowsBetween(Window.unboundedPreceding, -1))
    start = F.element_at(F.array(*[F.lit(x) for x in before]), F.col("bucket") + 1)
    light = light.withColumn("mid", start + F.coalesce(run, F.lit(0.0)) + F.col("weight") / 2)
    open_room = {k: max(v, 0.0) for k, v in room.items()}
    scale = rest / sum(open_room.values()) if sum(open_room.values()) else 0.0
    edge, choice = 0.0, None
    names = list(open_room)
    for k in names[:-1]:
        edge += open_room[k] * scale
        cond = F.col("mid") < edge
        choice = F.when(cond, k) if choice is None else choice.when(cond, k)
    choice = F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])
    return first.unionByName(light.select("group", choice.alias("split")))


def split_sentences(sentences: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """(docid, group_docid, split, n_sent): whole groups of docids in train, dev and test.

    Weights are distinct sentences; proportions default to 80/10/10.
    """
    g = cut(groups(sentences))
    n = sentences.where("docid is not null").select("docid", "sent_id").distinct().groupBy("docid").agg(F.count(F.lit(1)).alias("n_sent"))
    d = cut(g.join(n, "docid"))
    w = d.groupBy(F.col("group_docid").alias("group")).agg(F.sum("n_sent").alias("weight"))
    s = assign(w, proportions or {"train": 0.8, "dev": 0.1, "test": 0.1})
    return d.join(s.withColumnRenamed("group", "group_docid"), "group_docid").select("docid", "group_docid", "split", "n_sent")
