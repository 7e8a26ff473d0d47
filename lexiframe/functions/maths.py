"""Numeric functions: distance bins, log-space sums, activations, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper ends of the distance bins; what lies beyond is the last bin.
THRESHOLDS = (1, 2, 3, 4, 5, 10, 20)


def _bin(d: Column) -> Column:
    a, out = F.abs(d), None
    for i, t in enumerate(THRESHOLDS):
        out = F.when(a <= t, i + 1) if out is None else out.when(a <= t, i + 1)
    return out.otherwise(len(THRESHOLDS) + 1)


def distance_bin(d: Column) -> Column:
    """Signed number of the bin, 0 for 0."""
    return (F.signum(d.cast("double")).cast("int") * _bin(d)).cast("int")


def binned_distance(d: Column) -> Column:
    """Representative distance of the bin: 0 stays, beyond the thresholds it is 21 or -21; positive
    distances of the last two bins share 21."""
    b, out = _bin(d), None
    for i, t in enumerate(THRESHOLDS):
        out = F.when(b == i + 1, t) if out is None else out.when(b == i + 1, t)
    size = out.otherwise(21)
    return F.when(d == 0, 0).when(d > 0, F.when(b >= 7, 21).otherwise(size)).otherwise(-size).cast("int")


def log_sum(x: Column) -> Column:
    """Aggregate: log of the sum of exponentials; use with max_x of the same group as shift."""
    return F.log(F.sum(F.exp(x)))


def log_sum_array(a: Column) -> Column:
    """log sum exp of an array, shifted by its maximum."""
    m = F.array_max(a)
    return m + F.log(F.aggregate(F.transform(a, lambda x: F.exp(x - m)), F.lit(0.0), lambda s, x: s + x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def requ(x: Column) -> Column:
    return F.when(x > 0, x * x).otherwise(F.lit(0.0))


def cube(x: Column) -> Column:
    return x * x * x


def span_contains(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    return (b1 <= b2) & (e2 <= e1)


def span_crosses(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    return (b1 < b2) & (e1 < e2) & (e1 > b2) | (b2 < b1) & (e2 < e1) & (e2 > b1)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
