"""Filling fixed-capacity containers with items (problem 9).

A grouping genetic algorithm over blocks of items. A solution is a set of containers; crossover
injects whole well-filled containers of one parent into the other, containers that hold any of
their items are dissolved, displaced items change places with smaller ones where that fills a
container better, and what is then displaced is placed by best fit. Each block is evolved on
several islands with their own random numbers; after each epoch every island gets the elites of the
others. Containers that a block fills well are final; the items of its other ones go into the next
stage's blocks, for as long as that saves containers. Blocks are of bounded size, so no task sees
all items.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm import bpe
from lexiframe.session import cut, spread

#: Items of a block on average.
BLOCK = 800
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 2, 2, 8, 6, 2
#: Containers filled to this share are final.
WELL_FILLED = 0.995
#: Share of the ill-filled containers by which a stage must bring them down for another one to follow.
PROGRESS = 0.01

Bins = list[list[int]]


def place(items: list[int], sizes: list[int], bins: Bins, loads: list[int], capacity: int) -> None:
    """Best fit of items, in the given order, into bins, opening new ones."""
    room = sorted((capacity - load, i) for i, load in enumerate(loads))
    for x in items:
        s = sizes[x]
        at = bisect.bisect_left(room, (s, -1))
        if at < len(room):
            left, i = room.pop(at)
            bins[i].append(x)
            loads[i] += s
            bisect.insort(room, (left - s, i))
        else:
            bins.append([x])
            loads.append(s)
            bisect.insort(room, (capacity - s, len(bins) - 1))


def swap_in(displaced: list[int], sizes: list[int], bins: Bins, loads: list[int], capacity: int) -> list[int]:
    """Displaced items take the place of one or two smaller ones of a container where that fills it
    better; the items that are displaced afterwards."""
    todo = sorted(displaced, key=lambda x: -sizes[x])
    free: list[int] = []
    open_ = [i for i, load in enumerate(loads) if load < WELL_FILLED * capacity]
    while todo:
        x = todo.pop(0)
        s = sizes[x]
        best, where = 0, None
        for i in open_:
            room = capacity - loads[i]
            if s <= room:
                continue  # best fit will find it
            items = bins[i]
            for a, y in enumerate(items):
                gain = s - sizes[y]
                if best < gain <= room:
                    best, where = gain, (i, (a,))
                for b in range(a + 1, len(items)):
                    gain = s - sizes[y] - sizes[items[b]]
                    if best < gain <= room:
                        best, where = gain, (i, (a, b))
            if best and loads[where[0]] + best == capacity:
                break
        if where is None:
            free.append(x)
            continue
        i, out = where
        free += [bins[i][a] for a in out]
        bins[i] = [y for a, y in enumerate(bins[i]) if a not in out] + [x]
        loads[i] += best
        if loads[i] >= WELL_FILLED * capacity:
            open_.remove(i)
    return free


def fitness(loads: list[int], capacity: int) -> float:
    """Mean squared fill: of two solutions with as many containers, the one with fuller full ones."""
    return sum((x / capacity) ** 2 for x in loads) / len(loads) if loads else 1.0


def loads_of(bins: Bins, sizes: list[int]) -> list[int]:
    return [sum(sizes[x] for x in b) for b in bins]


def cross(into: Bins, giver: Bins, giver_loads: list[int], sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """A child: whole containers of the giver, chosen by their fill, inside of the other parent."""
    ranked = sorted(range(len(giver)), key=lambda i: (-giver_loads[i], rng.random()))
    well = max(1, int(len(ranked) * rng.uniform(0.2, 0.6)))
    chosen = [giver[i] for i in ranked[:well] if rng.random() < 0.8] or [giver[ranked[0]]]
    inside = {x for b in chosen for x in b}
    kept, displaced = [], []
    for b in into:
        if any(x in inside for x in b):
            displaced += [x for x in b if x not in inside]
        else:
            kept.append(b)
    child = [list(b) for b in kept] + [list(b) for b in chosen]
    loads = loads_of(child, sizes)
    # the emptiest container is dissolved too, so that its items can fill gaps
    for _ in range(2):
        if child and min(loads) < capacity:
            i = min(range(len(child)), key=loads.__getitem__)
            displaced += child.pop(i)
            loads.pop(i)
    displaced = swap_in(displaced, sizes, child, loads, capacity)
    displaced.sort(key=lambda x: -sizes[x])
    place(displaced, sizes, child, loads, capacity)
    return child


def evolve(sizes: list[int], capacity: int, seed: int, start: list[Bins], generations: int = GENERATIONS, population: int = POPULATION, elites: int = ELITES) -> list[Bins]:
    """The best solutions after some generations, the best first; start: solutions of other islands."""
    rng = random.Random(seed)
    down = sorted(range(len(sizes)), key=lambda x: -sizes[x])
    pool: list[tuple[float, Bins]] = []

    def add(bins: Bins) -> bool:
        """Is the search settled: does all room that is left lie in two containers at most, whose items
        go on to the next stage?"""
        loads = loads_of(bins, sizes)
        pool.append((fitness(loads, capacity), bins))
        return sum(x < WELL_FILLED * capacity for x in loads) <= 2

    settled = any([add(bins) for bins in start])
    while len(pool) < population and not settled:
        # largest first, at first strictly, then with some noise
        noise = 0.0 if not pool else rng.uniform(0.02, 0.3)
        order = sorted(down, key=lambda x: -sizes[x] * (1 + noise * rng.random())) if noise else down
        bins, loads = [], []
        place(order, sizes, bins, loads, capacity)
        settled = add(bins)
    for _ in range(generations):
        pool.sort(key=lambda p: -p[0])
        del pool[population:]
        parents = list(pool)
        for _ in range(0 if settled else population):
            a, b = rng.sample(parents, 2) if len(parents) > 1 else (parents[0], parents[0])
            if settled := add(cross(a[1], b[1], loads_of(b[1], sizes), sizes, capacity, rng)):
                break
        if settled:
            break
    pool.sort(key=lambda p: -p[0])
    return [bins for _, bins in pool[:elites]]


def _flat(solutions: list[Bins], n: int) -> list[int]:
    """Solutions as one list: for each, the number of the container of every item."""
    out = []
    for bins in solutions:
        of = [0] * n
        for i, b in enumerate(bins):
            for x in b:
                of[x] = i
        out += of
    return out


def _deep(flat: list[int], n: int) -> list[Bins]:
    out = []
    for s in range(0, len(flat), n or 1):
        of = [int(x) for x in flat[s : s + n]]
        bins: Bins = [[] for _ in range(max(of) + 1)]
        for x, i in enumerate(of):
            bins[i].append(x)
        out.append(bins)
    return out


def _stage(items: DataFrame, kind: str, capacity: int, stage: int) -> DataFrame:
    """(doc_id, piece, size, container, load) for items of one stage."""
    n = items.count()
    n_blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64(F.lit(stage), "doc_id", "piece"), F.lit(n_blocks))
    packed = F.array_sort(F.collect_list(F.struct("doc_id", "piece", "size"))).alias("items")
    blocks = spread(items.withColumn("block", block), "block").groupBy("block").agg(packed)
    state = blocks.select("block", "items.doc_id", "items.piece", "items.size", F.array().cast("array<int>").alias("elites"))
    schema = f"block bigint, island int, doc_id array<{kind}>, piece array<int>, size array<int>, elites array<int>, score double"

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    sizes = [int(s) for s in r.size_]
                    best = evolve(sizes, capacity, hash((stage, int(r.block), int(r.island), number)), _deep(r.elites, len(sizes)))
                    score = fitness(loads_of(best[0], sizes), capacity)
                    yield pd.DataFrame({"block": [r.block], "island": [r.island], "doc_id": [r.doc_id], "piece": [r.piece], "size": [r.size_], "elites": [_flat(best, len(sizes))], "score": [score]})

        return run

    for number in range(EPOCHS):
        islands = state.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumnRenamed("size", "size_")
        ran = spread(islands, "block", "island").mapInPandas(epoch(number), schema)
        if number + 1 < EPOCHS:
            # all elites of a block go to all its islands
            same = [F.first(c).alias(c) for c in ("doc_id", "piece", "size")]
            state = ran.groupBy("block").agg(*same, F.flatten(F.collect_list("elites")).alias("elites"))
    best = ran.groupBy("block").agg(F.max_by(F.struct("doc_id", "piece", "size", "elites"), F.struct("score", "island")).alias("b"))
    # the best solution stands first: its container of each item, then the load of each container
    at = F.arrays_zip(F.col("b.doc_id").alias("doc_id"), F.col("b.piece").alias("piece"), F.col("b.size").alias("size"), F.slice("b.elites", 1, F.size("b.size")).alias("bin"))
    flat = best.select("block", F.inline(at))
    load = F.sum("size").over(Window.partitionBy("block", "bin"))
    return flat.select("doc_id", "piece", "size", F.concat_ws(".", F.lit(stage), "block", "bin").alias("container"), load.cast("int").alias("load"))


def pack(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, begin, n_ids, container) for sizes (doc_id, n_ids).

    Items of no more than the capacity are not cut; a larger one gives full pieces, each a container
    of its own, and one rest. Null ids and items without size are left out; a repeated id counts once.
    """
    sizes = sizes.where("doc_id is not null and n_ids > 0").dropDuplicates(["doc_id"])
    kind = sizes.schema["doc_id"].dataType.simpleString()
    last = F.expr(f"cast(ceil(n_ids / {capacity}) as int) - 1")
    pieces = sizes.select("doc_id", F.col("n_ids").cast("int").alias("n_ids"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = cut(pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n_ids") - F.col("piece") * capacity).alias("size")))
    full = pieces.where(F.col("size") == capacity)
    placed = [full.select("doc_id", "piece", "size", F.concat(F.lit("full."), F.col("doc_id").cast("string"), F.lit("."), F.col("piece").cast("string")).alias("container"))]
    todo = pieces.where(F.col("size") < capacity)
    before, stage = None, 0
    poor_load = F.col("load") < WELL_FILLED * capacity
    while True:
        stage += 1
        done = cut(_stage(todo, kind, capacity, stage))
        poor = done.where(poor_load)
        per = poor.groupBy("container").agg(F.first("load").alias("load"))
        n_items = done.count()
        said = per.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("load"), F.lit(0)).alias("size")).first()
        # nothing to save, all items were in one block, or the stage brought next to nothing: all stay
        settled = said["n"] <= -(-said["size"] // capacity) or n_items <= BLOCK
        if settled or before is not None and said["n"] > (1 - PROGRESS) * before:
            placed.append(done.drop("load"))
            break
        placed.append(done.where(~poor_load).drop("load"))
        todo, before = poor.select("doc_id", "piece", "size"), said["n"]
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "piece", (F.col("piece") * capacity).alias("begin"), F.col("size").alias("n_ids"), "container")


def pack_documents(df: DataFrame, capacity: int = 2048, tokenizer_dir: str = bpe.TOKENIZER_DIR) -> DataFrame:
    """Containers of the texts' pieces, by their ids under the public tokenizer."""
    return pack(cut(bpe.count_ids(df, tokenizer_dir=tokenizer_dir)), capacity)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(n_items, n_containers, n_ids, least_containers, fill): one row about a packing."""
    c = packed.groupBy("container").agg(F.sum("n_ids").alias("load"), F.count(F.lit(1)).alias("k"))
    s = c.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("n_ids"))
    least = F.ceil(F.col("n_ids") / capacity)
    return s.select("*", least.alias("least_containers"), (F.col("n_ids") / (F.col("n_containers") * capacity)).alias("fill"))
