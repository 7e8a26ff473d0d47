"""Blocks that are rows are read as those of a file, and tagged sentences stay rows from the tables on."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA
from lexiframe.plans import common, registry
from lexiframe.sources import columns, lists

BLOCKS = [["a A x X", "b  B y Y ", " "], ["a A x Z"], [" "], ["c c q Q", "a l m M"], ["a A x X", "b B y Y"]]


def _both(spark):
    blocks = spark.createDataFrame([(b,) for b in BLOCKS], "lines array<string>")
    lines = [("f", i, x) for i, x in enumerate(x for b in BLOCKS for x in [*b, ""])]
    return blocks, spark.createDataFrame(lines, "file string, line_no int, text string")


@pytest.mark.parametrize("labelled", [True, False])
def test_blocks_in_rows_have_the_examples_of_the_file(spark, labelled):
    blocks, lines = _both(spark)
    got = columns.block_examples(blocks, labelled)
    assert len(got.collect()) == 4 and sorted(map(str, got.collect())) == sorted(map(str, columns.examples(lines, labelled).drop("id").collect()))


def test_morphology_of_blocks_in_rows(spark):
    blocks, lines = _both(spark)
    got = lists.morphology_blocks(blocks).select("key", F.inline("entries"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lists.morphology(lines).collect()))


def test_tagged_arrays_are_the_tagged_tokens(spark):
    got = common.tagged_arrays(spark, DATA).select("sent_id", F.inline("tokens"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, common.tagged(spark, DATA).collect()))


@pytest.mark.parametrize("name", ["column_corpus", "morphology_features"])
def test_tokens_are_not_shuffled_one_by_one(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan
