"""Training of chain and segment models over packed sentences, and shuffles that end with their action."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from lexiframe.operators import crf
from lexiframe.session import passing
from tests.conftest import DATA


def test_lists_of_features_are_read_once(spark, monkeypatch):
    """Before, every evaluation made an array of each token's features anew."""
    df = spark.createDataFrame([(i, [[1, 2], [3], [1, 2]][: i % 3 + 1], [0, 1, 0][: i % 3 + 1]) for i in range(30)], "sent_id int, features array<array<int>>, gold array<int>")
    p = crf.packs(df.coalesce(1), False).collect()
    assert len(p) == 1
    m = crf.Model(["a", "b"], np.random.default_rng(0).normal(size=(2, 8)), np.ones((3, 2)), np.zeros((2, crf.LENGTHS)), [1, 1])
    g, loss, good = crf._gradients(m, df.toPandas(), False)
    asked = []
    monkeypatch.setattr(crf, "distinct", lambda *a: asked.append(a))
    found, got = crf.evaluate(crf.packs(df, False), m, False, 30)
    assert not asked and found == pytest.approx(loss) and got == pytest.approx(-g) and good == 30


def test_packs_are_of_bounded_size(monkeypatch):
    seg = [{"begin": 0, "end": 2, "label": 1}, {"begin": 2, "end": 3, "label": 0}]
    rows = pd.DataFrame({"features": [[[0], [1, 2], [3]], [[1, 2]], []] * 20, "gold": [seg, [{"begin": 0, "end": 1, "label": 0}], []] * 20})
    m = crf.Model(["O", "A"], np.random.default_rng(2).normal(size=(2, 4)), np.zeros((3, 2)), np.zeros((2, crf.LENGTHS)), [1, 2])
    whole = crf._gradients(m, rows, True)
    monkeypatch.setattr(crf, "PACK", 5)
    assert len(list(crf._packed(rows, True))) == 20
    parts = crf._gradients(m, rows, True)
    assert parts[0] == pytest.approx(whole[0]) and parts[1:] == (pytest.approx(whole[1]), 40) and whole[2] == 40


def test_tagged_sentences_are_those_of_the_joins(spark):
    from lexiframe.plans.common import held_out, tagged, tagged_sentences, training

    got = tagged_sentences(spark, DATA)
    for held, way in ((True, held_out), (False, training)):
        want = way(tagged(spark, DATA), spark, DATA).select("sent_id", "pos", "word", "tag")
        have = got.where(F.col("held") == held).select("sent_id", "pos", "word", "tag")
        assert want.exceptAll(have).count() == 0 == have.exceptAll(want).count() and have.count()


def test_shuffles_end_with_their_action(spark):
    at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in at for a, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}

    before = files()
    with passing(spark):
        assert spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().count() == 7
    import time

    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before


def test_a_gradient_is_shuffled_by_each_core_and_not_by_each_partition(spark, monkeypatch):
    """Before, as many gradients of all weights were shuffled as the packs had partitions."""
    df = crf.packs(spark.createDataFrame([([[1, 2], [3]], [0, 1])] * 40, "features array<array<int>>, gold array<int>").repartition(20), False)
    m = crf.Model(["a", "b"], np.random.default_rng(3).normal(size=(2, 8)), np.ones((3, 2)), np.zeros((2, crf.LENGTHS)), [1, 1])
    whole, asked, real = crf.evaluate(df.coalesce(1), m, False, 40), [], crf.few_tasks
    monkeypatch.setattr(crf, "few_tasks", lambda x: asked.append(real(x)) or asked[-1])
    loss, g = crf.evaluate(df, m, False, 40)
    assert asked[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < df.rdd.getNumPartitions()
    assert loss == pytest.approx(whole[0]) and g == pytest.approx(whole[1])
