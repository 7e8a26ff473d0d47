import numpy as np
from lexiframe.llm import knn


def brute(x, ids, k, min_cos=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-c[i, j], ids[j]))[:k]
        out[a] = [(ids[j], c[i, j]) for j in order if min_cos is None or c[i, j] >= min_cos]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, vec array<float>, q string")


def test_recall_and_exactness(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    x = np.vstack([c + 0.3 * rng.normal(size=(50, 8)) for c in centres]).astype(np.float32)
    ids = list(range(len(x)))
    want = brute(x.astype(float), ids, 5)
    df = frame(spark, [(i, v.tolist(), "x") for i, v in zip(ids, x)])
    got = {r.id: [(n.id, n.cos) for n in r.neighbours] for r in knn.neighbours(df, dim=8, leaf=128, trees=4, visits=10).collect()}
    hits = sum(len({n for n, _ in want[i]} & {n for n, _ in got[i]}) for i in ids)
    assert hits / (5 * len(ids)) >= 0.9
    every = {r.vec_id for r in knn.search(df, 50, dim=8).collect()}
    assert every == {i for i in ids if i % 50 == 0}


def test_copies_ties_and_dirt(spark):
    base = [1.0] + [0.0] * 3
    rows = [(i, base, None) for i in range(9)] + [(20, [0.9, 0.1, 0.0, 0.0], "y"), (21, [0.0] * 4, "y"), (22, None, "y"), (23, [1.0, 2.0], "y"), (24, [float("nan"), 0.0, 0.0, 1.0], "y"), (25, [None, 0.0, 0.0, 1.0], "y"), (None, base, "y"), (20, [0.9, 0.1, 0.0, 0.0], "y")]
    got = {r.id: [n.id for n in r.neighbours] for r in knn.neighbours(frame(spark, rows), dim=4).collect()}
    assert set(got) == {*range(9), 20}
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[8] == [0, 1, 2, 3, 4] and got[20] == [0, 1, 2, 3, 4]
    pairs = {tuple(r) for r in knn.found(frame(spark, rows), 0.85, 5, 4).collect()}
    assert all(a < b for a, b in pairs) and (0, 20) in pairs and (5, 20) not in pairs and (5, 8) not in pairs and (0, 8) in pairs


def test_inseparable_leaves():
    # points on one ray can't be told apart by planes
    tree = knn.fit(np.tile(np.array([[1.0, 0.0]], np.float32), (300, 1)), 300 * 100, 1, 64)[0]
    assert len(tree.rows) == 1 and tree.walk() == [0]
    x = np.tile(np.array([[0.6, 0.8]], np.float32), (3000, 1))
    ids = np.random.default_rng(1).permutation(3000)
    a, b = knn._in_leaf(x[:40], ids[:40], x, ids, 5, None, 100, 4)
    for i in range(40):
        assert {0, 1, 2, 3, 4, 5} - {int(ids[i])} <= set(ids[b[a == i]].tolist()) and (a == i).sum() <= knn.CROWDED


def test_grown_leaves_are_searched_through_their_own_tree():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    x = np.vstack([c + 0.3 * rng.normal(size=(100, 16)) for c in centres]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    a, b = knn._in_leaf(x[::20], ids[::20], x, ids, 5, None, 256, 6)
    got = set(zip((a * 20).tolist(), b.tolist()))
    sim = x[::20] @ x.T
    sim[np.arange(len(sim)), ids[::20]] = -2
    want = {(i * 20, int(j)) for i, row in enumerate(sim) for j in np.argsort(-row)[:5]}
    assert len(want & got) / len(want) >= 0.95 and len(got) < 0.2 * len(sim) * len(x)


def test_regions_hold_each_leaf_once():
    rng = np.random.default_rng(2)
    forest = knn.fit(rng.normal(size=(4000, 8)).astype(np.float32), 400_000, 3, 1024)
    region, place = knn.regions(forest, 100.0)
    assert len(region) == sum(len(t.rows) for t in forest) == len(set(zip(region.tolist(), place.tolist())))
    assert place.max() < knn.REGION_LEAVES and all(sorted(t.walk()) == list(range(len(t.rows))) for t in forest)


def test_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6)).astype(np.float32)
    df = frame(spark, [(i, v.tolist(), "x") for i, v in enumerate(x)])
    got = {r.id: [(n.id, n.cos) for n in r.neighbours] for r in knn.neighbours(df, dim=6, leaf=40, exact=True).collect()}
    assert got == brute(x.astype(float), list(range(700)), 5)


def test_empty_and_single(spark):
    assert knn.neighbours(frame(spark, []), dim=4).count() == 0
    assert knn.neighbours(frame(spark, [(1, [1.0, 0.0, 0.0, 0.0], "")]), dim=4).first().neighbours == []
