"""Weights of many labels as a table of the shared folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import learning

LABELS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = [([int(x) for x in np.unique(rng.integers(0, 32, rng.integers(0, 5)))], LABELS[rng.integers(5)]) for _ in range(120)]
    return spark.createDataFrame([*made, *made[:40], ([3], "unlisted")], "features array<int>, label string")


@pytest.mark.parametrize("loss, optimizer", [("log", "adagrad"), ("log", "adadelta"), ("hinge", "adagrad"), ("perceptron", "adagrad"), ("mira", "adagrad")])
def test_stored_weights_are_those_of_the_driver(spark, rows, loss, optimizer):
    want = learning.fit(rows, LABELS, loss, 4, optimizer=optimizer, buckets=32)
    got = learning.fit_stored(rows.withColumn("n", F.lit(1)), LABELS, loss, 4, optimizer=optimizer, buckets=32)
    assert np.allclose(got.by_feature().T, want, atol=1e-12)
    a, b = (learning.predict(rows.where("label <> 'unlisted'"), w, LABELS, ["label"]).collect() for w in (want, got))
    assert a == b


@pytest.mark.parametrize("loss, optimizer", [("log", "adagrad"), ("log", "adadelta"), ("hinge", "adagrad")])
def test_the_driver_takes_no_weights(spark, rows, loss, optimizer, monkeypatch):
    """Before, it held the weights, their gradient and the optimizer's arrays, and sent them to the workers."""
    from pyspark import SparkContext
    from pyspark.sql.classic.dataframe import DataFrame

    collected, real = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(real(self)) or collected[-1])
    monkeypatch.setattr(SparkContext, "broadcast", lambda *a: pytest.fail("weights are broadcast"))
    w = learning.fit_stored(rows.withColumn("n", F.lit(1)), LABELS, loss, 2, optimizer=optimizer, buckets=32)
    learning.predict(rows, w, LABELS, ["label"])
    assert sum(len(x) for x in collected) <= 1


@pytest.mark.parametrize("loss", ["perceptron", "mira"])
def test_online_weights_are_those_of_one_pass_after_another(spark, rows, loss, monkeypatch):
    """Of one partition, with no weights in the driver: before, they were broadcast and six arrays held."""
    from pyspark import SparkContext

    monkeypatch.setattr(SparkContext, "broadcast", lambda *a: pytest.fail("weights are broadcast"))
    df = rows.where("label <> 'unlisted'").coalesce(1)
    made = df.collect()
    w, total = np.zeros((5, 32)), np.zeros((5, 32))
    for _ in range(3):
        for r in made:
            y, f = LABELS.index(r.label), list(r.features)
            s = w[:, f].sum(axis=1)
            m = s + (np.arange(5) != y) if loss == "mira" else s
            z = int(m.argmax())
            if z != y:
                size = min(1.0, (m[z] - s[y]) / (2 * max(1, len(f)))) if loss == "mira" else 1.0
                w[y, f] += size
                w[z, f] -= size
            total += w
    got = learning.fit_online_stored(df, LABELS, loss, 3, 32)
    assert np.allclose(got.by_feature().T, total / (3 * len(made)))
