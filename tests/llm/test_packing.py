import random

import pytest
from lexiframe.llm import packing
from pyspark.sql import functions as F


def test_evolve():
    r = random.Random(3)
    sizes = [r.randint(1, 900) for _ in range(300)]
    best = packing.evolve(sizes, 2048, 1, [])[0]
    assert sorted(x for b in best for x in b) == list(range(300))
    assert max(packing.loads_of(best, sizes)) <= 2048
    assert len(best) <= -(-sum(sizes) // 2048) + 1


@pytest.mark.parametrize("low,high,n", [(500, 1000, 300), (400, 800, 300), (200, 1000, 300)])
def test_gain_over_best_fit(low, high, n):
    """On sizes that best fit decreasing packs badly the search needs fewer containers."""
    r = random.Random(low)
    sizes = [r.randint(low, high) for _ in range(n)]
    bins, loads = [], []
    packing.place(sorted(range(n), key=lambda x: -sizes[x]), sizes, bins, loads, 2048)
    best = packing.evolve(sizes, 2048, 1, [])[0]
    assert sorted(x for b in best for x in b) == list(range(n)) and max(packing.loads_of(best, sizes)) <= 2048
    assert len(best) < len(bins)


def test_swap_in_keeps_every_item():
    sizes = [900, 800, 700, 600, 500, 400, 300]
    bins, loads = [[1, 4], [2, 5]], [1300, 1100]
    left = packing.swap_in([0, 3, 6], sizes, bins, loads, 2048)
    assert sorted([*left, *bins[0], *bins[1]]) == list(range(7)) and loads == packing.loads_of(bins, sizes) and max(loads) <= 2048


def test_pack(spark):
    r = random.Random(4)
    rows = [(i, r.choice([0, None, r.randint(1, 1500), r.randint(1, 300), 2048, 2049, 9000])) for i in range(3000)] + [(None, 5), (0, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_ids int")
    p = packing.pack(df.where("doc_id > 0"))
    p = p.cache()
    total = sum(n or 0 for i, n in rows if i and i > 0)
    assert p.agg(F.sum("n_ids")).first()[0] == total and p.count() == p.select("doc_id", "piece").distinct().count()
    load = p.groupBy("container").agg(F.sum("n_ids").alias("l"))
    assert load.agg(F.max("l")).first()[0] <= 2048
    small = {i for i, n in rows if n and n <= 2048}
    assert p.where("piece > 0 or begin > 0").select("doc_id").distinct().count() == len({i for i, n in rows if i and n and n > 2048})
    assert p.where(F.col("doc_id").isin(*list(small)[:200]) & (F.col("piece") > 0)).count() == 0
    assert packing.fill(p).first().fill > 0.99
    assert packing.pack(df.limit(0)).count() == 0
