"""Sums of long vectors over the workers, in blocks of bytes that Spark adds up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lexiframe.session import passing

#: Values of a block.
BLOCK = 1 << 14
SCHEMA = "block int, value binary"


def frames(v: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows (block, value) of a worker's vector, without blocks of zeros only."""
    for i in range(0, len(v), BLOCK):
        if v[i : i + BLOCK].any():
            yield pd.DataFrame({"block": [i], "value": [v[i : i + BLOCK].tobytes()]})


def _add(b: pd.DataFrame) -> pd.DataFrame:
    s = sum(np.frombuffer(v, dtype=np.float64) for v in b["value"])
    return pd.DataFrame({"block": b["block"].iloc[:1], "value": [s.tobytes()]})


def total(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], size: int) -> np.ndarray:
    """The sum of the vectors of that size that `run` gives by frames(); what comes to the driver are
    their bytes once, as few rows."""
    out = np.zeros(size)
    with passing(df.sparkSession):  # the plan is made in it, as it remembers what then held
        sums = df.mapInPandas(run, SCHEMA).groupBy("block").applyInPandas(_add, SCHEMA).collect()
    for r in sums:
        v = np.frombuffer(bytes(r["value"]), dtype=np.float64)
        out[r["block"] : r["block"] + len(v)] = v
    return out
