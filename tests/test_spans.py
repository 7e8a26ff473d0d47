from lexiframe.operators import evaluation, indexing, spans
from lexiframe.operators import wordfeats as wf
from pyspark.sql import functions as F


def toks(spark, *sents):
    return spark.createDataFrame([(i, p, w) for i, s in enumerate(sents) for p, w in enumerate(s.split())], "sent_id bigint, pos int, word string")


def test_bio_round_trip(spark):
    t = toks(spark, "a b c d e")
    seg = spark.createDataFrame([(0, "X", 0, 2), (0, "X", 2, 3), (0, "Y", 4, 5)], "sent_id bigint, label string, begin int, end int")
    bio = spans.bio_encode(t, seg)
    assert [r.bio for r in bio.orderBy("pos").collect()] == ["B-X", "I-X", "B-X", "O", "B-Y"]
    back = {(r.label, r.begin, r.end) for r in spans.bio_decode(bio).collect()}
    assert back == {("X", 0, 2), ("X", 2, 3), ("O", 3, 4), ("Y", 4, 5)}


def test_filter_words(spark):
    t = toks(spark, "a b . c d e f g")
    seg = spark.createDataFrame([(0, "X", 1, 4), (0, "Y", 4, 5), (0, "Z", 2, 3)], "sent_id bigint, label string, begin int, end int")
    got = {(r.label, r.begin, r.end) for r in spans.filter_words(t, seg, F.col("word") != ".").collect()}
    assert got == {("X", 1, 3), ("Y", 3, 4)}


def test_negation(spark):
    n = spans.negation_scope(toks(spark, "we do not like it . but yes"))
    assert [r.negated for r in n.orderBy("pos").collect()] == [False, False, False, True, True, False, False, False]


def test_gazetteer(spark):
    t = toks(spark, "in New York now", "New York New York")
    g = spark.createDataFrame([("LOC", ["New", "York"]), ("ORG", ["York"])], "type string, words array<string>")
    s = {(r.sent_id, r.begin, r.end, r.type) for r in spans.gazetteer_spans(t, g).collect()}
    assert (0, 1, 3, "LOC") in s and (0, 2, 3, "ORG") in s and (1, 2, 4, "LOC") in s and len(s) == 6
    w = {(r.sent_id, r.pos): r.types for r in spans.gazetteer_words(t, g).collect()}
    assert w[0, 1] == ["LOC"] and w[0, 2] == ["END-LOC", "END-ORG", "LOC", "ORG"]


def test_features(spark):
    t = toks(spark, "x y x", "z")
    c = {(r.sent_id, r.pos): r.c for r in t.select("sent_id", "pos", wf.context_set(F.col("word"), 1).alias("c")).collect()}
    assert c == {(0, 0): ["y"], (0, 1): ["x"], (0, 2): ["y"], (1, 0): []}
    n = {(r.sent_id, r.pos): r.f for r in wf.with_counts(t).select("sent_id", "pos", wf.identity(F.col("word"), F.col("n"), 1).alias("f")).collect()}
    assert n[0, 0] == "x" and n[0, 1] == "#UNK#"


def test_non_redundant(spark):
    f = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p"), ("b", "q"), ("b", "r"), ("b", "r")], "context string, feature string")
    assert sorted(r[0] for r in indexing.non_redundant(f).collect()) == ["p", "r"]
    i = {r.feature: r.id for r in indexing.feature_index(f.select("feature")).collect()}
    assert i == {"p": 0, "q": 1, "r": 2}
    assert indexing.feature_index(f.select("feature").limit(0)).count() == 0


def test_scores(spark):
    g = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "k int, l int")
    p = spark.createDataFrame([(2, 0), (3, 0), (4, 0), (4, 0)], "k int, l int")
    r = evaluation.precision_recall(g, p, ["k", "l"]).first()
    assert (r.n_gold, r.n_guess, r.n_right, r.precision) == (3, 3, 2, 0.666667)
    e = evaluation.tagging(spark.createDataFrame([], "sent_id bigint, pos int, gold string, pred string")).first()
    assert tuple(e) == (0, 0, 0, 0)


def test_sentiment(spark):
    # all right, then half of the polar ones on the wrong side
    cells = spark.createDataFrame([(0, 0, 5), (4, 0, 5), (2, 2, 10)], "gold int, pred int, n bigint")
    assert tuple(evaluation.sentiment_accuracy(cells).first()) == (0.75, 0.75, 0.5)
