"""Most similar vectors for every vector (problem 2).

A forest of random-projection trees is fitted on a bounded sample; every row is indexed. Each vector
goes to one leaf of every tree as data, and to the leaves that a best-first search over all trees
with one shared queue visits first as a query. The queue's order is the smallest margin on the path
to a leaf, and it is worked out for all leaves of a batch at once. Leaves are joined with their
queries by one shuffle; within a leaf a matrix product finds candidates, which are reranked by
their exact cosine in double precision.

Equal vectors are one entry of the index; each stands for its smallest ids, which are all that can
be among the nearest. Neighbouring leaves form regions; a vector is sent to a region once, with a mask
of the leaves it visits there. The forest's size is bounded by the sample, so above it leaves grow
with the collection; a leaf that has outgrown LEAF grows a tree of its own in the task that holds it,
and its queries search that tree best first. The work of a query thus stays near VISITS * LEAF rows
however large the collection is. With `exact` every query visits every leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.session import cut

#: Rows of the sample that the trees are fitted on, at most.
SAMPLE = 32_768
#: Rows of a leaf that trees aim at; a leaf of more than GROWN times that grows a tree of its own, of
#: whose leaves a query visits LOCAL_VISITS.
LEAF, GROWN, LOCAL_VISITS = 1_024, 4, 6
#: Ties of a query above which only the smallest ids among the highest cosines go on.
CROWDED = 256
#: Rows of a region that neighbouring leaves are put together to, and its leaves at most.
REGION, REGION_LEAVES = 16_384, 62
#: Trees, and leaves that each query visits (one of each tree among them). Of 120,000 vectors, pairs of
#: a cosine of at least 0.85 are found with a recall of 0.995 at 14 visits (0.990 at 10).
TREES = 4
VISITS = 14
#: Visits of a search without a least cosine: far neighbours lie in many leaves (recall 0.97; 0.79 at 10).
SEARCH_VISITS = 96


@dataclass
class Tree:
    """One tree in arrays: node i splits by normals[i] . x - offsets[i]; below[i] = (left, right), leaves as -1 - leaf."""

    normals: np.ndarray
    offsets: np.ndarray
    below: np.ndarray
    rows: np.ndarray  # of the sample, per leaf

    def walk(self) -> list[int]:
        """Leaves from left to right, so that neighbours stand side by side."""
        out, todo = [], [0 if len(self.normals) else -1]
        while todo:
            i = todo.pop()
            if i < 0:
                out.append(-1 - i)
            else:
                todo += [int(self.below[i, 1]), int(self.below[i, 0])]
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        """For each row, each leaf's smallest margin on the path; the own leaf has the only positive one."""
        n_leaves = len(self.rows)
        out = np.empty((len(x), n_leaves), dtype=np.float32)
        if len(self.normals) == 0:
            out[:] = np.inf
            return out
        side = x @ self.normals.T - self.offsets
        best = {0: np.full(len(x), np.inf, dtype=np.float32)}
        for i in range(len(self.normals)):  # parents stand before their children
            here = best.pop(i)
            for child, m in ((self.below[i, 0], side[:, i]), (self.below[i, 1], -side[:, i])):
                got = np.minimum(here, m)
                if child < 0:
                    out[:, -1 - child] = got
                else:
                    best[int(child)] = got
        return out


def fit(sample: np.ndarray, n_rows: int, trees: int, leaf: int, seed: int = 7) -> list[Tree]:
    """Trees over unit vectors: planes midway between two centres found in each node."""
    n = len(sample)
    scale = max(1.0, n_rows / max(n, 1))
    small = max(8, int(leaf / scale))
    forest = []
    for t in range(trees):
        rng = np.random.default_rng(seed + t)
        normals: list[np.ndarray] = []
        offsets: list[float] = []
        below: list[list[int]] = []
        sizes: list[int] = []
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(n), -1, 0)]  # rows, parent, side
        while todo:
            rows, parent, which = todo.pop(0)
            made = None
            if len(rows) > small:
                x = sample[rows]
                for _ in range(4):
                    a, b = x[rng.integers(len(x))].astype(np.float64), x[rng.integers(len(x))].astype(np.float64)
                    for _ in range(3):
                        near = (x @ (a - b)) > ((a @ a - b @ b) / 2)
                        if near.all() or not near.any():
                            break
                        a, b = x[near].mean(axis=0), x[~near].mean(axis=0)
                    normal = a - b
                    length = np.linalg.norm(normal)
                    if length < 1e-9:
                        continue
                    normal /= length
                    offset = float(normal @ (a + b) / 2)
                    left = (x @ normal - offset) > 0
                    if 0.1 * len(x) < left.sum() < 0.9 * len(x) or made is None and left.any() and not left.all():
                        made = (normal, offset, left)
                        if 0.1 * len(x) < left.sum() < 0.9 * len(x):
                            break
            if made is None:
                sizes.append(len(rows))
                at = -len(sizes)
            else:
                normals.append(made[0].astype(np.float32))
                offsets.append(made[1])
                below.append([0, 0])
                at = len(normals) - 1
                todo += [(rows[made[2]], at, 0), (rows[~made[2]], at, 1)]
            if parent >= 0:
                below[parent][which] = at
        dim = sample.shape[1] if sample.ndim == 2 else 0
        forest.append(Tree(np.array(normals, dtype=np.float32).reshape(-1, dim), np.array(offsets, dtype=np.float32), np.array(below, dtype=np.int64).reshape(-1, 2), np.array(sizes, dtype=np.int64)))
    return forest


def usable(vec: Column, dim: int) -> Column:
    """Not null, of the right size, without null, NaN or infinite entries, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) == dim) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(col: pd.Series, dim: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.float32).reshape(-1, dim).astype(kind)


def regions(forest: list[Tree], scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(region, place in it) of every leaf of all trees, by the rows that leaves are expected to hold."""
    region, place = [], []
    at = -1
    for t in forest:
        own, inside = np.zeros(len(t.rows), dtype=np.int64), np.zeros(len(t.rows), dtype=np.int64)
        held, k = np.inf, 0
        for leaf in t.walk():
            rows = t.rows[leaf] * scale
            if held + rows > REGION or k >= REGION_LEAVES:
                at, held, k = at + 1, 0.0, 0
            own[leaf], inside[leaf] = at, k
            held, k = held + rows, k + 1
        region.append(own)
        place.append(inside)
    return np.concatenate(region), np.concatenate(place)


def _pairs(q32: np.ndarray, qi: np.ndarray, d32: np.ndarray, di: np.ndarray, k: int, min_cos: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, held) places of each query's k nearest among the held rows, and of all that could tie."""
    outs = []
    for s in range(0, len(q32), 512):
        sim = q32[s : s + 512] @ d32.T
        sim[qi[s : s + 512, None] == di[None, :]] = -2
        if sim.shape[1] > k:
            floor = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k] - 2e-6
        else:
            floor = np.full(len(sim), -1.5, dtype=np.float32)
        floor = np.maximum(floor, -1.5 if min_cos is None else min_cos - 2e-6)
        near = sim >= floor[:, None]
        for i in np.flatnonzero(near.sum(axis=1) > CROWDED):
            # very many that could tie: the k smallest ids of the highest cosine, row by row
            at = np.flatnonzero(near[i])
            cos = np.round(d32[at].astype(np.float64) @ q32[s + i].astype(np.float64), 5)
            least = np.sort(cos)[-k]
            over = at[cos > least]
            tied = at[cos == least]
            some = np.r_[over, tied[np.argsort(di[tied], kind="stable")[:CROWDED]]] if len(over) < CROWDED else at[np.lexsort((di[at], -cos))[:CROWDED]]
            near[i] = False
            near[i, some] = True
        a, b = np.nonzero(near)
        outs.append((a + s, b))
    return np.concatenate([o[0] for o in outs]), np.concatenate([o[1] for o in outs])


def _in_leaf(q32: np.ndarray, qi: np.ndarray, d32: np.ndarray, di: np.ndarray, k: int, min_cos: float | None, leaf: int, local: int | None) -> tuple[np.ndarray, np.ndarray]:
    """_pairs of one leaf; one that has outgrown its size is searched through a tree of its own."""
    if len(d32) <= GROWN * leaf or local is None:
        return _pairs(q32, qi, d32, di, k, min_cos)
    tree = fit(d32, len(d32), 1, leaf)[0]
    home = np.concatenate([tree.margins(d32[s : s + 4096]).argmax(axis=1) for s in range(0, len(d32), 4096)])
    order = np.argsort(home, kind="stable")
    start = np.searchsorted(home[order], np.arange(len(tree.rows) + 1))
    asks: list[list[np.ndarray]] = [[] for _ in tree.rows]
    for s in range(0, len(q32), 4096):
        m = tree.margins(q32[s : s + 4096])
        w = min(local, m.shape[1])
        best = np.argpartition(-m, w - 1, axis=1)[:, :w]
        flat, row = best.ravel(), np.repeat(np.arange(len(m)), w) + s
        by = np.argsort(flat, kind="stable")
        cut_at = np.searchsorted(flat[by], np.arange(len(tree.rows) + 1))
        for i in range(len(tree.rows)):
            asks[i].append(row[by[cut_at[i] : cut_at[i + 1]]])
    outs = []
    for i, parts in enumerate(asks):
        rows, held = np.concatenate(parts), order[start[i] : start[i + 1]]
        if len(rows) and len(held):
            a, b = _pairs(q32[rows], qi[rows], d32[held], di[held], k, min_cos)
            outs.append((rows[a], held[b]))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate([o[0] for o in outs]), np.concatenate([o[1] for o in outs])) if outs else (none, none)


def _in_region(b: pd.DataFrame, dim: int, k: int, min_cos: float | None, leaf: int, local: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, cosine in double precision): for each query the k best of the region's
    leaves that it visits, and all ties."""
    x32 = _matrix(b["vec"], dim)
    norm = np.linalg.norm(x32.astype(np.float64), axis=1, keepdims=True)
    unit = (x32 / norm).astype(np.float32)
    ids, mask, hold = b["id"].to_numpy(), b["mask"].to_numpy(), b["hold"].to_numpy()
    outs = []
    for place in np.unique(hold[hold >= 0]):
        held, asking = np.flatnonzero(hold == place), np.flatnonzero((mask >> place) & 1)
        if len(asking):
            a, c = _in_leaf(unit[asking], ids[asking], unit[held], ids[held], k, min_cos, leaf, local)
            outs.append((asking[a], held[c]))
    if not outs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    a, c = np.concatenate([o[0] for o in outs]), np.concatenate([o[1] for o in outs])
    cos = np.empty(len(a))
    for s in range(0, len(a), 65_536):
        e = slice(s, s + 65_536)
        x, y = x32[a[e]].astype(np.float64) / norm[a[e]], x32[c[e]].astype(np.float64) / norm[c[e]]
        cos[e] = np.round(np.einsum("ij,ij->i", x, y), 6)
    # among ties at the k-th place only the smallest ids can be wanted
    order = np.lexsort((ids[c], -cos, a))
    a, c, cos = a[order], c[order], cos[order]
    start = np.r_[0, np.flatnonzero(np.diff(a)) + 1] if len(a) else np.zeros(0, dtype=np.int64)
    keep = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)])) < k
    return ids[a[keep]], ids[c[keep]], cos[keep]


def neighbours(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "vec",
    dim: int = 64,
    k: int = 5,
    min_cos: float | None = None,
    trees: int = TREES,
    visits: int = VISITS,
    leaf: int = LEAF,
    sample_rows: int = SAMPLE,
    every: int | None = None,
    exact: bool = False,
    local: int = LOCAL_VISITS,
) -> DataFrame:
    """(id, neighbours ARRAY<STRUCT<cos, id>>): for every usable vector the k others of highest
    cosine, rounded to 6 decimals, ties to the smaller id; with min_cos only those of at least it,
    and with `every` only for vectors whose id is divisible by it. With `exact` the answer is that of
    comparing all with all: one tree, of which every leaf is visited.

    Null ids and vectors that are null, all zero, of another size or with null, NaN or infinite
    entries take no part; a repeated id counts once. Tables with fewer than two vectors give empty lists.
    """
    spark = df.sparkSession
    trees, local_ = (1, None) if exact else (trees, local)
    v = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    v = v.where("id is not null").where(usable(F.col("vec"), dim))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # adding zero makes -0.0 and 0.0 the same bytes
            yield pd.DataFrame({"id": b["id"], "vec": [(np.asarray(x, dtype=np.float32) + np.float32(0)).tobytes() for x in b["vec"]]})

    v = v.mapInPandas(pack, "id bigint, vec binary").dropDuplicates(["id"])
    v = cut(v.withColumn("same", F.struct(F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec"))))
    narrow = v.select("id", "same")
    dup = narrow.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = cut(narrow.join(dup, "same").where("id <> rep").select("id", "rep"))
    reps = v.select("id", "vec").join(copies.select("id"), "id", "left_anti")

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values("id").groupby("rep", as_index=False).head(k)

    few = copies.mapInPandas(smallest, "id bigint, rep bigint")
    first = few.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k)
    kin = cut(first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("kin")))

    n = v.count() - copies.count()
    share = min(1.0, sample_rows / max(n, 1))
    picked = reps.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(2 * sample_rows)
    sample = _matrix(pd.Series([bytes(r[0]) for r in picked.select("vec").collect()], dtype=object), dim)
    if len(sample):
        sample /= np.linalg.norm(sample.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
    forest = fit(sample, n, trees, leaf) if len(sample) else fit(np.zeros((0, dim), np.float32), 0, trees, leaf)
    region, place = regions(forest, n / max(len(sample), 1))
    # the forest is as large as the sample allows
    sent = spark.sparkContext.broadcast((forest, region, place))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_, region_, place_ = sent.value
        for batch in batches:
            for s in range(0, len(batch), 1024):
                b = batch.iloc[s : s + 1024]
                x = _matrix(b["vec"], dim)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                m = np.concatenate([t.margins(x) for t in trees_], axis=1)
                w = m.shape[1] if exact else min(visits, m.shape[1])
                far = np.argpartition(-m, w - 1, axis=1)[:, :w] if w < m.shape[1] else np.tile(np.arange(w), (len(b), 1))
                asks = b["asks"].to_numpy()
                row, leaf_ = np.repeat(np.flatnonzero(asks), w), far[asks].ravel()
                homes, at = [], 0
                for t in trees_:
                    homes.append(at + m[:, at : at + len(t.rows)].argmax(axis=1))
                    at += len(t.rows)
                home = np.stack(homes, axis=1).ravel()
                # one row per vector and region: the leaves it visits there, and the one that holds it
                key = np.r_[row * (1 << 40) + region_[leaf_], np.repeat(np.arange(len(b)), len(trees_)) * (1 << 40) + region_[home]]
                kinds, inv = np.unique(key, return_inverse=True)
                mask, hold = np.zeros(len(kinds), dtype=np.int64), np.full(len(kinds), -1, dtype=np.int32)
                np.bitwise_or.at(mask, inv[: len(row)], np.int64(1) << place_[leaf_])
                hold[inv[len(row) :]] = place_[home]
                of = kinds >> 40
                yield pd.DataFrame({"cell": kinds & ((1 << 40) - 1), "id": b["id"].to_numpy()[of], "vec": b["vec"].to_numpy()[of], "mask": mask, "hold": hold})

    asked = lambda c: F.lit(True) if every is None else F.pmod(c, F.lit(every)) == 0
    asking = reps.withColumn("asks", asked(F.col("id")))
    if every is not None:  # an entry asks for its copies too
        for_copies = copies.where(asked(F.col("id"))).select(F.col("rep").alias("id"), F.lit(True).alias("more")).distinct()
        asking = asking.join(for_copies, "id", "left").select("id", "vec", (F.col("asks") | F.coalesce("more", F.lit(False))).alias("asks"))
    routed = asking.mapInPandas(route, "cell bigint, id bigint, vec binary, mask bigint, hold int")

    def in_cell(b: pd.DataFrame) -> pd.DataFrame:
        a, c, cos = _in_region(b, dim, k, min_cos, leaf, local_)
        return pd.DataFrame({"q": a, "id": c, "cos": cos})

    near = routed.groupBy("cell").applyInPandas(in_cell, "q bigint, id bigint, cos double")
    if min_cos is not None:
        near = near.where(F.col("cos") >= min_cos)
    # one entry of the index stands for its copies
    item = F.transform(F.concat(F.array("id"), F.coalesce("kin", F.array().cast("array<bigint>"))), lambda i: F.struct((-F.col("cos")).alias("neg"), i.alias("id")))
    best = near.groupBy("q").agg(F.collect_set(F.struct("id", "cos")).alias("s")).select("q", F.explode("s").alias("s")).select("q", "s.id", "s.cos")
    best = best.join(kin.withColumnRenamed("rep", "id"), "id", "left").select("q", F.explode(item).alias("e"))
    best = best.groupBy("q").agg(F.array_sort(F.collect_list("e")).alias("e"))
    best = reps.select(F.col("id").alias("q")).join(best, "q", "left").join(kin.withColumnRenamed("rep", "q"), "q", "left")
    own_kin = F.when(F.col("kin").isNotNull(), F.transform(F.concat(F.array("q"), "kin"), lambda i: F.struct(F.lit(-1.0).alias("neg"), i.alias("id"))))
    e = F.array_sort(F.concat(F.coalesce("e", F.array().cast("array<struct<neg:double,id:bigint>>")), F.coalesce(own_kin, F.array().cast("array<struct<neg:double,id:bigint>>"))))
    best = best.select("q", e.alias("e"))
    of_copies = copies.join(best.withColumnRenamed("q", "rep"), "rep").select("id", "e")
    everyone = best.select(F.col("q").alias("id"), "e").unionByName(of_copies)
    everyone = everyone.where(asked(F.col("id")))
    top = F.slice(F.filter("e", lambda s: s["id"] != F.col("id")), 1, k)
    return everyone.select("id", F.transform(top, lambda s: F.struct((-s["neg"]).alias("cos"), s["id"].alias("id"))).alias("neighbours"))


def found(df: DataFrame, min_cos: float = 0.85, k: int = 5, dim: int = 64, visits: int = VISITS) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: pairs of at least min_cos of which one is among the k nearest of the other."""
    n = neighbours(df, k=k, dim=dim, min_cos=min_cos, visits=visits).select("id", F.explode("neighbours").alias("n"))
    return n.select(F.least("id", "n.id").alias("vec_id_a"), F.greatest("id", "n.id").alias("vec_id_b")).distinct()


def search(df: DataFrame, every: int = 50, k: int = 5, dim: int = 64, visits: int = SEARCH_VISITS, exact: bool = False) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine): the k nearest of every vector whose id is divisible by
    `every`, among all vectors."""
    n = neighbours(df, k=k, dim=dim, every=every, visits=visits, exact=exact)
    return n.select(F.col("id").alias("vec_id"), F.posexplode("neighbours").alias("p", "n")).select("vec_id", (F.col("p") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), F.col("n.cos").alias("cosine"))
