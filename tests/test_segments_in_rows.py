"""Entities are found in their sentence's row, so neither trees nor tokens are shuffled for them."""

import pytest
from tests.conftest import DATA
from lexiframe.operators import spans
from lexiframe.plans import registry

ROW = "sent_id bigint, words array<string>, annotations struct<ner: array<struct<ner_type: string, span_begin: int, span_end: int>>>"


def test_segments_of_a_row_are_those_of_the_window(spark):
    ner = [("B", 1, 3), ("A", 1, 3), ("A", 0, 1), ("A", 0, 1), ("C", 2, 9), (None, 3, 4), ("D", None, 2), ("D", -1, 1), ("D", 4, 4), ("E", 2, 5), ("F", 4, 5), ("G", 5, 6)]
    s = spark.createDataFrame([(1, list("abcdef"), (ner,)), (2, ["a"], ([],)), (3, ["a"], (None,)), (4, [], ([("A", 0, 1)],)), (5, ["a"], None)], ROW)
    got = {(r["sent_id"], x["label"], x["begin"], x["end"]) for r in spans.with_segments(s).collect() for x in r["segments"] or []}
    assert got == {tuple(r) for r in spans.entity_segments(s).drop("n_words").collect()} == {(1, "A", 0, 1), (1, "A", 1, 3), (1, "G", 5, 6)}


@pytest.mark.parametrize("name", ["gazetteer_word", "gazetteer_span", "span_edges"])
def test_neither_trees_nor_tokens_of_entities_are_shuffled(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "tree" not in plan
    assert name != "span_edges" or "posexplode" not in plan
