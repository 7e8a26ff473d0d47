"""Training of linear multiclass models by batch updates over distributed rows.

Each pass is one job: workers turn their rows into sums of all weights, which Spark adds up in blocks. The
weights are an array of labels by hashed features, a stated bound that doesn't grow with the data. Where
labels are many, that array is a table in the shared folder with a row per label (Stored), which workers
read and write and the driver doesn't hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.operators import blocks
from lexiframe.session import cut, passing, release, spread

#: Hash buckets of features.
BUCKETS = 1 << 14
#: Labels whose weights a worker moves at once, scores that it works out at once, and rows whose prediction it keeps.
LABELS, SCORES, KEPT = 128, 1 << 20, 1 << 15
#: Labels whose weights go between a table and a worker's array at once.
FEW = 32


def hash_features(features: Column, buckets: int = BUCKETS) -> Column:
    return F.array_distinct(F.transform(features, lambda f: F.pmod(F.xxhash64(f), F.lit(buckets)).cast("int")))


class Adadelta:
    """Step sizes from running means of squared gradients and steps."""

    def __init__(self, shape, rho: float = 0.95, eps: float = 1e-6):
        self.g, self.d, self.rho, self.eps = np.zeros(shape), np.zeros(shape), rho, eps

    def step(self, grad: np.ndarray) -> np.ndarray:
        move = np.empty_like(grad)
        for i, x in enumerate(grad):  # label by label, as the driver holds few arrays of all weights
            self.g[i] = self.rho * self.g[i] + (1 - self.rho) * x**2
            move[i] = np.sqrt((self.d[i] + self.eps) / (self.g[i] + self.eps)) * x
            self.d[i] = self.rho * self.d[i] + (1 - self.rho) * move[i] ** 2
        return move


class Adagrad:
    def __init__(self, shape, rate: float = 0.5):
        self.g, self.rate = np.zeros(shape), rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        move = np.empty_like(grad)
        for i, x in enumerate(grad):
            self.g[i] += x**2
            move[i] = self.rate * x / (np.sqrt(self.g[i]) + 1e-8)
        return move


def batch_gradient(w: np.ndarray, idx: np.ndarray, on: np.ndarray, gold: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """(d (n, labels), loss (n)): per row the factor by which its features move each label's weights.

    idx (n, F) are features, padded; on (n, F) says which places hold one.
    """
    s = (w[:, idx] * on).sum(axis=2).T
    n, rows = len(gold), np.arange(len(gold))
    if loss == "log":
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        out = -np.log(np.maximum(p[rows, gold], 1e-300))
        p *= -1
        p[rows, gold] += 1
        return p, out
    margin = s + (1.0 if loss in ("hinge", "mira") else 0.0)
    margin[rows, gold] = s[rows, gold]
    y = margin.argmax(axis=1)
    lost = margin[rows, y] - s[rows, gold]
    step = (y != gold).astype(float)
    if loss == "mira":  # the smallest move that keeps the margin, at most one
        step *= np.minimum(1.0, lost / (2 * np.maximum(1, on.sum(axis=1))))
    d = np.zeros((n, len(w)))
    d[rows, gold] += step
    d[rows, y] -= step
    return d, lost


def padded(features) -> tuple[np.ndarray, np.ndarray]:
    size = max([1, *map(len, features)])
    idx, on = np.zeros((len(features), size), dtype=np.int64), np.zeros((len(features), size))
    for i, f in enumerate(features):
        idx[i, : len(f)], on[i, : len(f)] = f, 1.0
    return idx, on


def fit(rows: DataFrame, labels: list[str], loss: str = "log", passes: int = 8, l2: float = 1e-4, optimizer: str = "adagrad", buckets: int = BUCKETS) -> np.ndarray:
    """Weights (labels, buckets) for rows (features ARRAY<INT>, label STRING); losses: log, hinge,
    perceptron, mira. Perceptron and mira weights are averaged over the passes."""
    of = {y: i for i, y in enumerate(labels)}
    w = np.zeros((len(labels), buckets))
    opt = {"adagrad": Adagrad, "adadelta": Adadelta}[optimizer](w.shape)
    total = np.zeros_like(w) if loss in ("perceptron", "mira") else None
    # equal rows move the weights equally, so each is kept once with its number
    rows = cut(spread(rows.groupBy("features", "label").agg(F.count(F.lit(1)).alias("n")), "features"))
    n = max(1, rows.agg(F.sum("n")).first()[0] or 0)
    for _ in range(passes):
        sent = rows.sparkSession.sparkContext.broadcast(w)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            g = np.zeros_like(sent.value)
            for b in batches:
                b = b[b["label"].isin(of)]
                for at in range(0, len(b), 2048):
                    part = b.iloc[at : at + 2048]
                    idx, on = padded(part["features"].tolist())
                    d, _ = batch_gradient(sent.value, idx, on, part["label"].map(of).to_numpy(), loss)
                    d *= part["n"].to_numpy()[:, None]
                    for j in range(idx.shape[1]):
                        np.add.at(g.T, idx[:, j], d * on[:, j : j + 1])
            yield from blocks.frames(g.ravel())

        g = blocks.total(rows.select("features", "label", "n"), run, w.size).reshape(w.shape)
        sent.destroy()
        g /= n
        for i in range(len(g)):
            g[i] -= l2 * w[i]
        w += opt.step(g)
        if total is not None:
            total += w
    release(rows)
    return total / passes if total is not None else w


class Stored:
    """Weights as a table (label INT, w BINARY and what else belongs to it) in the shared folder; the
    frame is that of the table, and None stands for zeros."""

    def __init__(self, df: DataFrame | None, labels: int, buckets: int):
        self.path = df._lexiframe_path if df is not None else None
        self.labels, self.buckets = labels, buckets

    def rows(self, first: int, last: int, cols: tuple[str, ...]) -> list[np.ndarray]:
        """Arrays (last - first, buckets) of labels from first until before last."""
        out = [np.zeros((last - first, self.buckets)) for _ in cols]
        if self.path:
            here = (dataset.field("label") >= first) & (dataset.field("label") < last)
            for b in batches_of(self.path, ["label", *cols], here, 16):
                for x, c in zip(out, cols):
                    for y, v in zip(b.column("label").to_pylist(), b.column(c)):
                        if v.is_valid:
                            x[y - first] = np.frombuffer(v.as_buffer(), dtype=np.float64)
        return out

    def by_feature(self) -> np.ndarray:
        """(buckets, labels) weights."""
        out = np.zeros((self.buckets, self.labels))
        for i in range(0, self.labels, FEW):
            last = min(self.labels, i + FEW)
            out[:, i:last] = self.rows(i, last, ("w",))[0].T
        return out


def batches_of(path: str, cols: list[str], where=None, size: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """A table of the shared folder, read by a worker."""
    files, at = fs.FileSystem.from_uri(path)
    names = sorted(x.path for x in files.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet"))
    if names:
        yield from dataset.dataset(names, filesystem=files, format="parquet").scanner(columns=cols, filter=where, batch_size=size, batch_readahead=1, fragment_readahead=1, use_threads=False).to_batches()


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many of them each row has) of ARRAY<INT>."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)


def lots(flat: np.ndarray, many: np.ndarray, labels: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows, and their features, that are scored together."""
    ends = np.r_[0, np.cumsum(many)]
    size = max(1, SCORES // (labels * max(1, int(many.max(initial=1)))))
    for at in range(0, len(many), size):
        last = min(len(many), at + size)
        yield slice(at, last), flat[ends[at] : ends[last]]


def scores(by_feature: np.ndarray, flat: np.ndarray, many: np.ndarray) -> np.ndarray:
    """(rows, labels): sums of the weights of each row's features."""
    out = np.zeros((len(many), by_feature.shape[1]))
    some = np.flatnonzero(many)
    if len(some):
        out[some] = np.add.reduceat(by_feature[flat], (np.cumsum(many) - many)[some], axis=0)
    return out


def decided(s: np.ndarray, gold: np.ndarray, many: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best, step, z) of rows with scores (n, labels), as batch_gradient() has them: the label that loses
    `step` to the gold, or with log the log partition."""
    rows = np.arange(len(gold))
    if loss == "log":
        top = s.max(axis=1, keepdims=True)
        return np.full(len(gold), -1), np.ones(len(gold)), (top + np.log(np.exp(s - top).sum(axis=1, keepdims=True)))[:, 0]
    margin = s + (1.0 if loss in ("hinge", "mira") else 0.0)
    margin[rows, gold] = s[rows, gold]
    best = margin.argmax(axis=1)
    step = (best != gold).astype(float)
    if loss == "mira":
        step *= np.minimum(1.0, (margin[rows, best] - s[rows, gold]) / (2 * np.maximum(1, many)))
    return best, step, np.zeros(len(gold))


def fit_stored(rows: DataFrame, labels: list[str], loss: str = "log", passes: int = 8, l2: float = 1e-4, optimizer: str = "adagrad", buckets: int = BUCKETS) -> Stored:
    """fit() of rows (features, label, n), n being how often a row occurs, without an array of all weights in
    the driver or in a shuffle: first the rows are scored, then each worker goes over all of them for labels
    of its own. What is read over and again are the different rows."""
    spark, size = rows.sparkSession, len(labels)
    number = F.map_from_arrays(F.lit(labels), F.sequence(F.lit(0), F.lit(size - 1)))
    rows = rows.groupBy("features", "label").agg(F.sum("n").alias("n"))
    rows = cut(spread(rows.select("features", F.try_element_at(number, F.col("label")).alias("y"), "n"), "features"))
    n = max(1, rows.agg(F.sum("n")).first()[0] or 0)
    rows_of = rows.where("y is not null")
    kinds = {"adagrad": (Adagrad, ("g",)), "adadelta": (Adadelta, ("g", "d"))}
    made, kept = kinds[optimizer]
    averaged = loss in ("perceptron", "mira")
    state, now = None, Stored(None, size, buckets)
    for last in range(passes - 1, -1, -1):

        def score(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            w = None
            for b in batches:
                w = now.by_feature() if w is None else w
                flat, many = lists(b.column("features"))
                gold = np.asarray(b.column("y")).astype(np.int64)
                got = [decided(scores(w, f, many[at]), gold[at], many[at], loss) for at, f in lots(flat, many, size)]
                best, step, z = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, int), np.zeros(0), np.zeros(0))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("features", "y", "n")), pa.array(best, pa.int32()), pa.array(step), pa.array(z)], names=["features", "y", "n", "best", "step", "z"])

        scored = cut(rows_of.mapInArrow(score, "features array<int>, y int, n bigint, best int, step double, z double"))

        def move(batches: Iterator[pa.RecordBatch], now=now, at=scored._lexiframe_path, last=last) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([np.zeros(0, int), *(np.asarray(b.column("id")) for b in batches)])
            for i in range(0, len(ids), LABELS):  # a partition's labels follow each other
                first, end = int(ids[i]), int(ids[min(len(ids), i + LABELS) - 1]) + 1
                w, *more = now.rows(first, end, ("w", *kept, *["total"] * averaged))
                g = gradient(w, first, at, loss)
                g /= n
                g -= l2 * w
                opt = made(w.shape)
                for k, x in zip(kept, more):
                    setattr(opt, k, x)
                w += opt.step(g)
                if averaged:
                    more[-1] += w
                out = dict(zip(("w", *kept, *["total"] * averaged), (w, *more)))
                if not last:  # nothing but the weights is asked for
                    out = {"w": out["total"] / passes if averaged else w}
                for j in range(0, end - first, 16):
                    cells = [pa.array([x.tobytes() for x in out[k][j : j + 16]] if k in out else [None] * len(w[j : j + 16]), pa.binary()) for k in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(range(first + j, first + j + len(cells[0])), pa.int32()), *cells], names=["label", *cols])

        cols = ("w", *kept, *["total"] * averaged)
        old, state = state, cut(spark.range(0, size, 1, max(1, min(size, spark.sparkContext.defaultParallelism))).mapInArrow(move, "label int, " + ", ".join(f"{c} binary" for c in cols)))
        now = Stored(state, size, buckets)
        release(scored)
        release(old)
    release(rows)
    return now


def gradient(w: np.ndarray, first: int, path: str, loss: str) -> np.ndarray:
    """The rows' sum for the labels from `first` on, whose weights are w."""
    by_feature, out = np.ascontiguousarray(w.T), np.zeros((w.shape[1], len(w)))
    for b in batches_of(path, ["features", "y", "n", "best", "step", "z"]):
        flat, many = lists(b.column("features"))
        y, n, best, step, z = (np.asarray(b.column(c)) for c in ("y", "n", "best", "step", "z"))
        for at, f in lots(flat, many, len(w)):
            k = n[at].astype(float)
            d = np.exp(scores(by_feature, f, many[at]) - z[at, None]) * -k[:, None] if loss == "log" else np.zeros((len(k), len(w)))
            for label, sign in ((y[at], 1.0), (best[at], -1.0)):
                own = np.flatnonzero((label >= first) & (label < first + len(w)))
                np.add.at(d, (own, label[own] - first), sign * (step[at] * k)[own])
            row = np.repeat(np.arange(len(k)), many[at])
            order = np.argsort(f, kind="stable")
            f = f[order]
            if len(f):
                start = np.r_[0, np.flatnonzero(np.diff(f)) + 1]
                out[f[start]] += np.add.reduceat(d[row[order]], start, axis=0)
    return np.ascontiguousarray(out.T)


def online_pass(w: np.ndarray, features: list[np.ndarray], gold: np.ndarray, loss: str, cap: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, sum of the weights over the steps) after one update per row, in order.

    perceptron: the gold's and the wrongly best label's weights move by one. mira: they move by the
    least that gives the gold a margin of one, at most by `cap`."""
    v = np.array(w.T, order="C")  # by feature, so that a row's weights lie together
    o = Online(v, loss, cap)
    o.go([np.ascontiguousarray(f, dtype=np.int64).tobytes() for f in features], np.asarray(gold).tolist())
    return v.T, o.summed(slice(None)).T


class Online:
    """Updates of weights (buckets, labels) in place, row by row.

    A row that called for no move calls for none until one of its features' weights has moved, so it isn't
    scored again before that."""

    def __init__(self, v: np.ndarray, loss: str, cap: float = 1.0):
        self.v, self.loss, self.cap, self.step = v, loss, cap, 0
        # moves by the step they were made at, for the sum over all steps; by label, as most labels move little and untouched memory isn't taken
        self.late = np.zeros(v.shape[::-1])
        self.moved = [-1] * len(v)  # the step at which a feature's weights moved last
        self.seen: dict[bytes, tuple] = {}

    def go(self, rows: list[bytes], gold: list[int]) -> None:
        """Rows are the bytes of their features (int64)."""
        v, late, moved, seen, mira = self.v, self.late, self.moved, self.seen, self.loss == "mira"
        s, m = np.empty(v.shape[1]), np.empty(v.shape[1])
        if len(seen) > KEPT:
            seen.clear()
        for step, (key, y) in enumerate(zip(rows, gold), self.step):
            known = seen.get(key)
            if known is None:
                f = np.frombuffer(key, dtype=np.int64)
                known = seen[key] = (f, f.tolist(), {})
            f, each, right = known
            at = right.get(y, -1)
            if at >= 0:
                for j in each:
                    if moved[j] > at:
                        break
                else:
                    continue
            np.add.reduce(v.take(f, axis=0), axis=0, out=s)
            size = 1.0
            if mira:
                np.add(s, 1.0, out=m)
                m[y] = s[y]
                z = int(m.argmax())
                size = min(self.cap, (m[z] - s[y]) / (2 * max(1, len(each))))
            else:
                z = int(s.argmax())
            if z == y:
                right[y] = step
                continue
            v[f, y] += size
            v[f, z] -= size
            late[y, f] += size * step
            late[z, f] -= size * step
            for j in each:
                moved[j] = step
        self.step += len(gold)

    def summed(self, labels) -> np.ndarray:
        """Sum of some labels' weights over the steps."""
        return self.v[:, labels] * self.step - self.late[labels].T


def fit_online(rows: DataFrame, labels: list[str], loss: str = "perceptron", passes: int = 5, buckets: int = BUCKETS) -> np.ndarray:
    """The weights (labels, buckets) of fit_online_stored(), for few labels."""
    return fit_online_stored(rows, labels, loss, passes, buckets).by_feature().T


def fit_online_stored(rows: DataFrame, labels: list[str], loss: str = "perceptron", passes: int = 5, buckets: int = BUCKETS) -> Stored:
    """Averaged weights of an online learner over distributed rows (features, label).

    In every pass each partition updates the common weights row by row, in its own order; the
    partitions' weights are then mixed by their mean, and their sums over all steps give the average.
    What is shuffled are weights that aren't zero; what comes to the driver are two numbers."""
    spark, count = rows.sparkSession, len(labels)
    number = F.map_from_arrays(F.lit(labels), F.sequence(F.lit(0), F.lit(count - 1)))
    rows = rows.select("features", F.try_element_at(number, F.col("label")).alias("y")).where("y is not null")
    state, now, steps = None, Stored(None, count, buckets), 0.0
    for left in range(passes - 1, -1, -1):

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            o = None
            for b in batches:
                if b.num_rows:
                    o = o or Online(now.by_feature(), loss)
                    flat, many = lists(b.column("features"))
                    raw, ends = flat.tobytes(), np.r_[0, np.cumsum(many) * 8].tolist()
                    o.go([raw[i:j] for i, j in zip(ends, ends[1:])], np.asarray(b.column("y")).tolist())
            if o is None:
                return
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.zeros(2, np.int32), np.array([1.0, o.step]), np.zeros(2)))], names=["label", "at", "move", "total"])
            for i in range(0, count, FEW):
                end = min(count, i + FEW)
                move, total = o.v[:, i:end].T - now.rows(i, end, ("w",))[0], o.summed(slice(i, end)).T
                for y in range(end - i):
                    some = np.flatnonzero((move[y] != 0) | (total[y] != 0))
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array([i + y], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (some.astype(np.int32), move[y, some], total[y, some]))], names=["label", "at", "move", "total"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            label, sums = None, np.zeros((2, max(2, buckets)))
            for b in batches:
                for y, *cells in zip(*(b.column(c).to_pylist() for c in ("label", "at", "move", "total"))):
                    if label is not None and y != label:
                        yield row(label, sums)
                        sums[:] = 0.0
                    label, at = y, np.frombuffer(cells[0], dtype=np.int32) if y >= 0 else np.arange(2)
                    sums[0, at] += np.frombuffer(cells[1], dtype=np.float64)
                    sums[1, at] += np.frombuffer(cells[2], dtype=np.float64)
            if label is not None:
                yield row(label, sums)

        def row(label: int, sums: np.ndarray) -> pa.RecordBatch:
            size = buckets if label >= 0 else 2
            return pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), *(pa.array([x[:size].tobytes()], pa.binary()) for x in sums)], names=["label", "move", "total"])

        with passing(spark):
            moves = rows.mapInArrow(run, "label int, at binary, move binary, total binary")
            sums = cut(spread(moves, "label").sortWithinPartitions("label").mapInArrow(add, "label int, move binary, total binary"))
        made = [np.frombuffer(bytes(r["move"]), dtype=np.float64) for r in sums.where("label < 0").collect()]  # one row at most
        parts, n = made[0] if made else (0.0, 0.0)
        steps += n

        def mix(batches: Iterator[pa.RecordBatch], now=now, moved=Stored(sums, count, buckets), parts=parts, left=left, steps=steps) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([np.zeros(0, int), *(np.asarray(b.column("id")) for b in batches)])
            for i in range(0, len(ids), FEW):  # a partition's labels follow each other
                first, end = int(ids[i]), int(ids[min(len(ids), i + FEW) - 1]) + 1
                (w, total), (move, more) = now.rows(first, end, ("w", "total")), moved.rows(first, end, ("move", "total"))
                w, total = w + move / max(1.0, parts), total + more
                out = (w, total) if left else (total / max(1.0, steps), None)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, end), pa.int32()), *(pa.array([None] * len(w) if x is None else [r.tobytes() for r in x], pa.binary()) for x in out)], names=["label", "w", "total"])

        old, state = state, cut(spark.range(0, count, 1, max(1, min(count, spark.sparkContext.defaultParallelism))).mapInArrow(mix, "label int, w binary, total binary"))
        now = Stored(state, count, buckets)
        release(sums)
        release(old)
    return now


def predict(rows: DataFrame, w: np.ndarray | Stored, labels: list[str], keep: list[str]) -> DataFrame:
    """Adds `pred` to rows with a features column."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    sent = w if isinstance(w, Stored) else rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, names = None, pa.array(labels, pa.string())
        seen: dict[bytes, int] = {}  # rows recur, as words do
        for b in batches:
            if v is None:
                v = sent.by_feature() if isinstance(sent, Stored) else np.ascontiguousarray(sent.value.T)
            flat, many = lists(b.column("features"))
            raw, ends = flat.tobytes(), np.r_[0, np.cumsum(many) * 8].tolist()
            rows = [raw[i:j] for i, j in zip(ends, ends[1:])]
            if len(seen) > KEPT:
                seen.clear()
            new = [k for k in dict.fromkeys(rows) if k not in seen]
            flat, many = np.frombuffer(b"".join(new), dtype=np.int64), np.array([len(k) // 8 for k in new], dtype=np.int64)
            best = [scores(v, f, many[at]).argmax(axis=1) for at, f in lots(flat, many, len(labels))]
            seen.update(zip(new, np.concatenate([np.zeros(0, int), *best]).tolist()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), names.take(pa.array([seen[k] for k in rows], pa.int64()))], names=[*keep, "pred"])

    return rows.select(*keep, "features").mapInArrow(run, f"{kinds}, pred string")


def perceptron_sequences(sentences: list[tuple[np.ndarray, list[int]]], n_labels: int, passes: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Averaged structured perceptron over a bounded sample of (features (n, F), labels): emission
    weights (labels, F) and transitions (labels + 1, labels)."""
    from lexiframe.operators.sequence import viterbi

    f = sentences[0][0].shape[1]
    e, t = np.zeros((n_labels, f)), np.zeros((n_labels + 1, n_labels))
    ea, ta = e.copy(), t.copy()
    for _ in range(passes):
        for x, y in sentences:
            z = viterbi(x @ e.T, t)
            if z != y:
                for seq, sign in ((y, 1.0), (z, -1.0)):
                    prev = n_labels
                    for i, k in enumerate(seq):
                        e[k] += sign * x[i]
                        t[prev, k] += sign
                        prev = k
            ea += e
            ta += t
    m = passes * len(sentences)
    return ea / m, ta / m
