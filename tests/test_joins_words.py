"""Tables by word grow with the data too."""

import re

from lexiframe.operators import sequence
from lexiframe.session import cut


def test_tables_by_word_are_not_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "1g")
    try:
        t = cut(spark.createDataFrame([(1, 0, "a", "X"), (1, 1, "b", "Y")], "sent_id bigint, pos int, word string, tag string"))
        _, e, _ = sequence.hmm_tables(t)
        plan = e._jdf.queryExecution().executedPlan().toString()
        assert len(e.collect()) == 2
    finally:
        spark.conf.set(key, old)
    joins = re.findall(r"(\w+Join) \[(\w+?)#", plan)
    assert ("SortMergeJoin", "word") in joins and ("BroadcastHashJoin", "word") not in joins
