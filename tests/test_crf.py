"""Chain and segment CRFs against enumeration, finite differences and held-out accuracy."""

import itertools

import numpy as np
import pandas as pd
import pytest
from lexiframe.operators import crf


def model(rng, s=3, buckets=12, longest=None):
    m = crf.Model.zeros([chr(65 + i) for i in range(s)], buckets, longest)
    return m.of(rng.normal(size=len(m.vector())) * 0.7)


def segmentations(n, longest):
    if n == 0:
        yield []
        return
    for y, most in enumerate(longest):
        for k in range(1, min(n, most) + 1):
            for head in segmentations(n - k, longest):
                yield [*head, (n - k, n, y)]


def score(m, table, segs):
    prev, out = len(m.labels), 0.0
    for b, e, y in segs:
        out += table[b, e - b - 1, y] + m.trans[prev, y]
        prev = y
    return out


@pytest.mark.parametrize("seed", range(4))
def test_segments_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    m = model(rng, longest=[1, 3, 2])
    table = crf.segment_table(m, m.scores([rng.integers(0, 12, 3) for _ in range(4)]))
    every = list(segmentations(4, m.longest))
    values = np.array([score(m, table, s) for s in every])
    z = np.log(np.exp(values).sum())
    marg, pairs, got_z = crf.segment_marginals(table, m.trans)
    assert abs(got_z - z) < 1e-9
    want = np.zeros_like(marg)
    moves = np.zeros_like(pairs)
    for s, v in zip(every, values):
        prev = 3
        for b, e, y in s:
            want[b, e - b - 1, y] += np.exp(v - z)
            moves[prev, y] += np.exp(v - z)
            prev = y
    assert np.allclose(marg, want) and np.allclose(pairs, moves)
    assert crf.segment_viterbi(table, m.trans) == every[int(values.argmax())]
    value = lambda s: sum(marg[b, e - b - 1, y] for b, e, y in s)
    best = max(value(s) for s in every if all(y != 0 or e - b == 1 for b, e, y in s))
    got = crf.segment_posterior(marg, 0)
    inside = {i for b, e, _ in got for i in range(b, e)}
    assert all(y != 0 for _, _, y in got) and abs(value([*got, *((i, i + 1, 0) for i in range(4) if i not in inside)]) - best) < 1e-9


def test_chain_against_enumeration():
    rng = np.random.default_rng(1)
    m = model(rng)
    emit = rng.normal(size=(2, 4, 3))
    marg, pairs, z = crf.chain_marginals(emit, m.trans)
    for k in range(2):
        ps = {y: emit[k, range(4), y].sum() + m.trans[-1, y[0]] + sum(m.trans[a, b] for a, b in zip(y, y[1:])) for y in itertools.product(range(3), repeat=4)}
        total = np.log(sum(np.exp(v) for v in ps.values()))
        assert abs(z[k] - total) < 1e-9
        assert abs(marg[k, 2, 1] - sum(np.exp(v - total) for y, v in ps.items() if y[2] == 1)) < 1e-9
        assert abs(pairs[k, 0, 2] - sum(np.exp(v - total) * sum(a == 0 and b == 2 for a, b in zip(y, y[1:])) for y, v in ps.items())) < 1e-9


def test_scaled_counts_are_those_of_logs():
    rng = np.random.default_rng(6)
    for scale in (1.0, 30.0, 2000.0):
        m, emit = model(rng, 4), rng.normal(size=(5, 6, 4)) * scale
        use = np.array([True, False, True, True, False])
        for got, want in zip(crf.chain_counts(emit, m.trans, use), (lambda a, p, z: (a, p[use].sum(axis=0), z))(*crf.chain_marginals(emit, m.trans))):
            assert np.allclose(got, want, atol=1e-8)
    assert crf.chain_counts(emit[:, :1], m.trans)[1][-1].sum() == pytest.approx(5)


@pytest.mark.parametrize("segments", [False, True])
def test_gradient_is_the_slope(segments):
    rng = np.random.default_rng(2)
    m = model(rng, longest=[1, 3, 2] if segments else None)
    feats = [[rng.integers(0, 12, 2) for _ in range(5)], [rng.integers(0, 12, 2) for _ in range(3)]]
    if segments:
        gold = [[{"label": 0, "begin": 0, "end": 1}, {"label": 1, "begin": 1, "end": 4}, {"label": 2, "begin": 4, "end": 5}], [{"label": 2, "begin": 0, "end": 2}, {"label": 0, "begin": 2, "end": 3}]]
    else:
        gold = [[0, 1, 1, 2, 0], [2, 0, 1]]
    df = pd.DataFrame({"features": feats, "gold": gold})
    g, loss, good = crf._gradients(m, df, segments)
    assert good == 2
    v = m.vector()
    for i in rng.choice(len(v), 40, replace=False):
        up, down = v.copy(), v.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (crf._gradients(m.of(up), df, segments)[1] - crf._gradients(m.of(down), df, segments)[1]) / 2e-5
        assert abs(-g[i] - slope) < 1e-5


def test_augmentation_and_masks():
    rng = np.random.default_rng(3)
    m = model(rng, longest=[1, 3, 2])
    emit = m.scores([rng.integers(0, 12, 2) for _ in range(4)])
    gold = [(0, 1, 0), (1, 4, 1)]
    a = crf.loss_augmentation(gold, 4, 3, 3)
    assert a[0, 0, 0] == -1 and a[1, 2, 1] == -1 and (a == 1).sum() == a.size - 2
    marg, _, _ = crf.segment_marginals(crf.segment_table(m, emit), m.trans)
    keep = crf.constraints_of(marg, 0.05)
    masked, _, _ = crf.segment_marginals(crf.segment_table(m, emit, keep), m.trans)
    assert (masked[keep < 0] < 1e-12).all() and abs(masked.sum(axis=(1, 2)).max()) <= 1 + 1e-9
    gm = crf.gold_marginals(gold, 4, 3, 3)
    assert gm.sum() == 2 and gm[1, 2, 1] == 1


def test_left_out_sentences_are_scaled_for():
    m = crf.Model.zeros(["A", "B"], 4, [1, 2])
    rows = pd.DataFrame({"features": [[[0], [1], [2]]] * 2, "gold": [[{"label": 1, "begin": 0, "end": 3}], [{"label": 0, "begin": i, "end": i + 1} for i in range(3)]]})
    assert crf._gradients(m, rows, True)[2] == 1  # the first has a segment longer than its label may be


def test_lbfgs_finds_the_least():
    a = np.diag([1.0, 10.0, 100.0])
    x, v = crf.lbfgs(lambda x: (0.5 * float((x - 1) @ a @ (x - 1)), a @ (x - 1)), np.zeros(3), 60)
    assert np.allclose(x, 1, atol=1e-3) and v < 1e-5


def test_fit_on_frames(spark):
    from pyspark.sql import functions as F

    rows = [(s, p, w, t) for s in range(60) for p, (w, t) in enumerate([("the", "D"), (f"n{s % 7}", "N"), ("saw", "V"), ("the", "D"), (f"n{(s + 3) % 7}", "N")])]
    t = spark.createDataFrame(rows, "sent_id bigint, pos int, word string, tag string")
    labels = ["D", "N", "V"]
    number = F.map_from_arrays(F.lit(labels), F.lit([0, 1, 2]))
    s = crf.sequences(t, F.array("word"), F.col("tag"), buckets=64)
    m = crf.fit(s.withColumn("gold", F.transform("labels", lambda y: F.try_element_at(number, y))), labels, steps=8, buckets=64)
    got = {(r.sent_id, r.pos): r.tag for r in crf.tag(s, m).collect()}
    assert sum(got[i, p] == y for i, p, _, y in rows) == len(rows)
    assert crf.tag(s.limit(0), m).count() == 0


@pytest.mark.parametrize("loss", ["perceptron", "mira"])
def test_online_learners(spark, loss):
    from lexiframe.operators import learning

    rng = np.random.default_rng(7)
    rows = [([int(y * 3 + rng.integers(3)), int(9 + rng.integers(5))], "abc"[y]) for y in rng.integers(0, 3, 400)]
    df = spark.createDataFrame(rows, "features array<int>, label string").repartition(3)
    w = learning.fit_online(df, ["a", "b", "c"], loss, 3, 16)
    p = learning.predict(df, w, ["a", "b", "c"], ["label"])
    assert p.where("label = pred").count() == 400
    assert not learning.fit_online(df.limit(0), ["a", "b"], loss, 1, 4).any()


def test_an_online_pass_is_step_by_step():
    from lexiframe.operators import learning

    rng = np.random.default_rng(8)
    feats, gold = [rng.choice(6, 2, replace=False) for _ in range(30)], rng.integers(0, 3, 30)
    w, total = np.zeros((3, 6)), np.zeros((3, 6))
    for f, y in zip(feats, gold):
        z = int(w[:, f].sum(axis=1).argmax())
        if z != y:
            w[y, f] += 1
            w[z, f] -= 1
        total += w
    got, summed = learning.online_pass(np.zeros((3, 6)), feats, gold, "perceptron")
    assert np.allclose(got, w) and np.allclose(summed, total)
    m, _ = learning.online_pass(np.zeros((2, 6)), feats[:1], np.array([0]), "mira")
    s = m[:, feats[0]].sum(axis=1)
    assert s[0] - s[1] == pytest.approx(1.0)  # the least move that gives a margin of one


def test_features_of_equal_words_are_scored_once(monkeypatch):
    """Before, every token's features were summed up anew in every evaluation."""
    import pandas as pd

    asked, real = [], crf.Model.scores
    monkeypatch.setattr(crf.Model, "scores", lambda self, f: asked.append(len(f)) or real(self, f))
    f = [np.array([1, 2]), np.array([3])]
    df = pd.DataFrame({"features": [[f[0], f[1], f[0]], [f[1], f[1]]], "gold": [[0, 1, 0], [1, 1]]})
    crf._gradients(crf.Model.zeros(["a", "b"], 8), df, False)
    assert sum(asked) == 2


def test_sums_of_vectors_come_in_blocks(spark):
    """Before, a row per weight came to the driver."""
    from lexiframe.operators import blocks

    def run(batches):
        v = np.zeros(40_000)
        for b in batches:
            np.add.at(v, b["id"].to_numpy(), 1.0)
        yield from blocks.frames(v)

    got = blocks.total(spark.range(0, 40_000, 3, 4), run, 40_000)
    assert got.sum() == 13_334 and got[::3].all() and not got[1::3].any()
