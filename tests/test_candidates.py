"""Decoding over the labels that words were seen with, with sentences as rows."""

import numpy as np
import pytest

from lexiframe.operators import sequence
from lexiframe.plans.common import tagged, tagged_arrays
from tests.conftest import DATA


@pytest.mark.parametrize("labels", [1, 7, 40])
def test_candidates_give_the_labels_of_the_dense_search(labels):
    r = np.random.default_rng(labels)
    many = r.integers(1, min(labels, 5) + 1, 30)
    ys = np.concatenate([np.sort(r.choice(labels, m, replace=False)) for m in many])
    scores = np.round(r.normal(size=many.sum() + labels), 1)  # rounded, for ties
    e = sequence.Entries(np.r_[many, labels], np.r_[ys, np.arange(labels)], scores)
    trans = np.round(r.normal(size=(labels + 1, labels)))
    sizes = r.integers(0, 9, 200)
    codes = r.integers(0, 31, sizes.sum())
    got, (likely, prob) = e.viterbi(codes, sizes, trans), e.posterior(codes, sizes, trans)
    dense = np.full((31, labels), sequence.BARRED)
    dense[np.repeat(np.arange(31), e.many), e.labels] = e.scores
    for b, n in zip(np.cumsum(sizes) - sizes, sizes):
        if n:
            emit = dense[codes[b : b + n]]
            assert got[b : b + n].tolist() == sequence.viterbi(emit, trans)
            m = sequence.batch_marginals(emit[None], trans)[0]
            assert likely[b : b + n].tolist() == m.argmax(axis=1).tolist() and prob[b : b + n] == pytest.approx(m.max(axis=1))


def test_tables_of_rows_are_those_of_tokens(spark):
    for a, b in zip(sequence.hmm_tables(tagged(spark, DATA)), sequence.hmm_tables_of(tagged_arrays(spark, DATA))):
        rows = lambda df: sorted((*r[:-1], round(r[-1], 9)) for r in df.collect())
        assert rows(a) == rows(b)


def test_no_scores_are_shuffled(spark):
    """Before, every token took a score of each label through two shuffles."""
    from lexiframe.plans import models

    plan = models.hmm_viterbi(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan
