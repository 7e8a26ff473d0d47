"""The segment model's sentences stay rows from the tables on."""

from pyspark.sql import functions as F
from tests.conftest import DATA
from lexiframe.operators import spans
from lexiframe.plans import common, crfs


def test_filled_segments_are_those_of_the_tokens(spark):
    one, t = common.one_sentences(spark, DATA), common.tokens(spark, DATA)
    number = lambda y: F.length(y)
    got = crfs._entities(spark, DATA).select("sent_id", F.inline(spans.filled_segments(number)))
    want = spans.fill_gaps(spans.entity_segments(one).drop("n_words"), t)
    want = want.select("sent_id", "begin", "end", F.when(F.col("label") == "O", 0).otherwise(F.length("label")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_training_takes_rows_where_they_lie(spark, monkeypatch):
    """Features were shuffled twice, and trees with them."""
    seen = []
    monkeypatch.setattr(crfs.crf, "fit", lambda df, *a, **k: seen.append((df, k)))
    crfs._segmenter(crfs._entities(spark, DATA))
    df, k = seen[0]
    assert k["placed"] and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
