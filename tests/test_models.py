import itertools

import numpy as np
import pytest
from lexiframe.operators import dense, learning, parsing, sequence, trees

TREE = "(S (NP (DT The) (NN dog)) (VP (VBD saw) (NP (DT a) (JJ big) (NN cat))) (. .))"


def brute(emit, trans):
    n, s = emit.shape
    out = {}
    for y in itertools.product(range(s), repeat=n):
        v = trans[-1, y[0]] + sum(emit[i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        out[y] = v
    return out


def test_chain_against_brute_force():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    all_ = brute(emit, trans)
    z = np.log(sum(np.exp(v) for v in all_.values()))
    m, got = sequence.marginals(emit, trans)
    assert got == pytest.approx(z)
    for t in range(4):
        for k in range(3):
            assert m[t, k] == pytest.approx(sum(np.exp(v - z) for y, v in all_.items() if y[t] == k))
    assert tuple(sequence.viterbi(emit, trans)) == max(all_, key=all_.get)
    assert sequence.transition_marginals(emit, trans).sum(axis=(1, 2)) == pytest.approx(np.ones(4))


def test_umbrella():
    # rain stays with 0.7, umbrellas are seen on rainy days with 0.9, else with 0.2
    trans = np.log(np.array([[0.7, 0.3], [0.3, 0.7], [0.5, 0.5]]))
    emit = np.log(np.array([[0.9, 0.2] if u else [0.1, 0.8] for u in (1, 1, 0, 1, 1)]))
    rainy = sequence.marginals(emit, trans)[0][:, 0]
    assert rainy == pytest.approx([0.8673, 0.8204, 0.3075, 0.8204, 0.8673], abs=1e-4)
    unit = sequence.segment_scores(emit, [1, 1])
    marg, z = sequence.semi_marginals(unit, trans, 5)
    assert [marg[i, i + 1, 0] for i in range(5)] == pytest.approx(rainy.tolist())
    assert [y for _, _, y in sequence.semi_viterbi(unit, trans, 5)] == sequence.viterbi(emit, trans)


def test_semi_chain_sums_to_one():
    rng = np.random.default_rng(2)
    emit, trans = rng.normal(size=(5, 2)), rng.normal(size=(3, 2))
    marg, _ = sequence.semi_marginals(sequence.segment_scores(emit, [1, 3]), trans, 5)
    for t in range(5):
        assert sum(p for (b, e, _), p in marg.items() if b <= t < e) == pytest.approx(1.0)
    got = sequence.semi_posterior_decode(marg, 5, 0)
    assert all(y == 1 and b < e for b, e, y in got)


def test_tree_round_trips():
    t = trees.read(TREE)
    assert trees.render(t) == TREE
    assert trees.expand_unaries(trees.debinarize(trees.binarize(trees.collapse_unaries(t), trees.head_child))) == t
    assert trees.read("(X (-LRB- -LRB-))")[1][0][1] == "("
    assert [trees.read(x) for x in (None, "", "(S", "S)", "(S x))")] == [None] * 5


def test_tree_clean_up():
    t = trees.read("(S (NP-SBJ-1 (DT The) (NN dog)) (VP (VBD ran) (S (NP (-NONE- *-1)))))")
    assert trees.render(trees.standardize(t)) == "(S (NP (DT The) (NN dog)) (VP (VBD ran)))"
    assert trees.render(trees.annotate_parents(trees.read(TREE))).startswith("(S (NP^S (DT The)")
    assert trees.spans(t)[5][1:3] == (2, 3)


def test_heads():
    d = trees.dependencies(trees.read(TREE))
    assert d == [(0, 1, "DT"), (1, 2, "NP"), (2, 7, "ROOT"), (3, 5, "DT"), (4, 5, "JJ"), (5, 2, "NP"), (6, 2, ".")]


def toy():
    # S -> A B (1), A -> A A (.4), tags A, B; unary B -> C (.5)
    u = np.full((4, 4), parsing.NEG)
    np.fill_diagonal(u, 0.0)
    u[2, 3] = np.log(0.5)
    root = np.array([0.0, parsing.NEG, parsing.NEG, parsing.NEG])
    return parsing.Grammar(["S", "A", "B", "C"], np.array([0, 1]), np.array([1, 1]), np.array([2, 1]), np.log([1.0, 0.4]), u, root)


def test_chart():
    g = toy()
    lex = np.full((4, 4), parsing.NEG)
    lex[:3, 1] = 0.0
    lex[3, 3] = 0.0
    _, _, z = parsing.inside(g, lex)
    assert np.exp(z) == pytest.approx(2 * 0.4**2 * 0.5)  # two trees
    t, v = parsing.best_tree(g, lex, list("wxyz"))
    assert np.exp(v) == pytest.approx(0.4**2 * 0.5) and trees.render(t).endswith("(B (C z)))")
    k = parsing.k_best(g, lex, list("wxyz"), 3)
    assert len(k) == 2 and len({trees.render(t) for _, t in k}) == 2
    post, _ = parsing.span_posteriors(g, lex)
    assert post[0, 4, 0] == pytest.approx(1) and post[0, 2, 1] == pytest.approx(0.5) and post[0, 3, 1] == pytest.approx(1)
    assert parsing.best_tree(g, lex[:2], list("wx"))[0] is None


def test_unary_closure():
    u = np.full((3, 3), parsing.NEG)
    u[0, 1], u[1, 2] = -1.0, -2.0
    c = parsing.unary_closure(u)
    assert c[0, 2] == -3.0 and c[1, 1] == 0.0


def test_layer_gradients():
    rng = np.random.default_rng(3)
    net = [(rng.normal(size=(3, 4)), rng.normal(size=3), "tanh"), (rng.normal(size=(2, 3)), rng.normal(size=2), "sigmoid")]
    x = rng.normal(size=(5, 4))
    f = lambda: dense.forward(x, net).sum()
    g = dense.gradient(x, net, np.ones((5, 2)))
    for (w, _, _), (dw, _) in zip(net, g):
        base = f()
        w[0, 1] += 1e-6
        assert (f() - base) / 1e-6 == pytest.approx(dw[0, 1], abs=1e-3)
        w[0, 1] -= 1e-6


@pytest.mark.parametrize("loss", ["log", "hinge", "perceptron", "mira"])
def test_classifiers(spark, loss):
    rows = spark.createDataFrame([([1, 2], "a"), ([2, 3], "b"), ([4], "c"), ([1], "a"), ([], "a")], "features array<int>, label string")
    w = learning.fit(rows, ["a", "b", "c"], loss, 12, buckets=16)
    got = learning.predict(rows.where("size(features) > 0"), w, ["a", "b", "c"], ["label"]).collect()
    assert all(r.label == r.pred for r in got)


def test_structured_perceptron():
    x = [np.eye(2)[[0, 1, 0]], np.eye(2)[[1, 1, 0]]]
    e, t = learning.perceptron_sequences([(x[0], [0, 1, 0]), (x[1], [1, 1, 0])], 2)
    assert sequence.viterbi(x[0] @ e.T, t) == [0, 1, 0]
