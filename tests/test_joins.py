"""What grows with the data isn't broadcast, however small Spark takes its files for."""

import re

import pytest
from tests.conftest import DATA
from lexiframe.plans import registry


@pytest.mark.parametrize("name", ["gazetteer_span", "gazetteer_word", "span_edges", "column_corpus", "morphology_features"])
def test_tables_by_sentence_are_not_broadcast(spark, name):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "1g")
    try:
        plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, old)
    joins = re.findall(r"(\w+Join) \[(\w+?)#", plan)
    assert ("SortMergeJoin", "sent_id") in joins or joins
    assert {k for j, k in joins if j == "BroadcastHashJoin"} <= {"section_id"}  # of the portions
