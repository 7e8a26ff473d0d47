"""Sums of vectors leave no shuffle files behind."""

import os
import time

import numpy as np
from lexiframe.operators import blocks


def test_passes_leave_no_shuffles(spark):
    """Before, those of every pass stayed until the driver collected its garbage."""
    at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in at for a, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}

    def run(batches):
        v = np.zeros(40_000)
        for b in batches:
            np.add.at(v, b["id"].to_numpy(), 1.0)
        yield from blocks.frames(v)

    before = files()
    assert blocks.total(spark.range(0, 40_000, 3, 4), run, 40_000).sum() == 13_334
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
