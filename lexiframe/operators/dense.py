"""Dense layers over array columns, and their gradients for checks.

Forward passes are JVM-side array expressions; weights are literals of a layer's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def affine(x: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    """One output per row of the weights."""
    return F.array(*[dot(x, literal(w)) + float(b) for w, b in zip(weights, bias)])


def activate(x: Column, kind: str) -> Column:
    f = {
        "tanh": F.tanh,
        "relu": lambda v: F.greatest(v, F.lit(0.0)),
        "requ": lambda v: F.when(v > 0, v * v).otherwise(F.lit(0.0)),
        "cube": lambda v: v * v * v,
        "sigmoid": lambda v: 1 / (1 + F.exp(-v)),
        "identity": lambda v: v,
    }[kind]
    return F.transform(x, f)


def dropout(x: Column, keep: float, seed_col: Column) -> Column:
    """A mask drawn from a hash of the row's key and the place, scaled so that the mean stays."""
    draw = lambda i: F.pmod(F.xxhash64(seed_col, i), F.lit(1_000_000)) / 1_000_000
    return F.transform(x, lambda v, i: F.when(draw(i) < keep, v / keep).otherwise(F.lit(0.0)))


def batch_statistics(df: DataFrame, col: str = "x") -> DataFrame:
    """(i, mean, inverse_std) of each dimension of an array column."""
    e = df.select(F.posexplode(col).alias("i", "v"))
    return e.groupBy("i").agg(F.avg("v").alias("mean"), (1 / F.sqrt(F.var_pop("v") + 1e-4)).alias("inverse_std"))


def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray, str]]) -> np.ndarray:
    """The same layers in NumPy."""
    act = {"tanh": np.tanh, "relu": lambda v: np.maximum(v, 0), "requ": lambda v: np.maximum(v, 0) ** 2, "cube": lambda v: v**3, "sigmoid": lambda v: 1 / (1 + np.exp(-v)), "identity": lambda v: v}
    for w, b, kind in layers:
        x = act[kind](x @ w.T + b)
    return x


def gradient(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray, str]], out_grad: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradients of weights and biases of each layer, given that of the output."""
    slope = {
        "tanh": lambda v: 1 - np.tanh(v) ** 2,
        "relu": lambda v: (v > 0).astype(float),
        "requ": lambda v: 2 * np.maximum(v, 0),
        "cube": lambda v: 3 * v**2,
        "sigmoid": lambda v: (s := 1 / (1 + np.exp(-v))) * (1 - s),
        "identity": np.ones_like,
    }
    inputs, pres = [], []
    for w, b, kind in layers:
        inputs.append(x)
        pres.append(x @ w.T + b)
        x = forward(x, [(w, b, kind)])
    grads, g = [], out_grad
    for (w, _, kind), i, pre in zip(reversed(layers), reversed(inputs), reversed(pres)):
        g = g * slope[kind](pre)
        grads.append((g.T @ i, g.sum(axis=0)))
        g = g @ w
    return grads[::-1]
