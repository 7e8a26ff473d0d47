import pytest
from lexiframe.functions import maths, stemming
from lexiframe.functions import words as W
from lexiframe.operators import treebank
from pyspark.sql import functions as F


def column(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, w string")
    return [r[0] for r in df.select("i", f(F.col("w")).alias("x")).orderBy("i").select("x").collect()]


def test_shape_and_class(spark):
    assert column(spark, ["Hello", "USA", "a1", "1234", "x-Y", ""], W.shape) == ["Xxxe", "XXe", "xd", "dde", "x-X", ""]
    words = ["Running", "cats", "bus", "USA", "well-known", "A1", "quickly", "the"]
    assert column(spark, words, W.word_class) == ["-INITC-ing", "-LC-s", "-LC", "-CAPS", "-LC-DASH", "-INITC-NUM", "-LC-ly", "-LC"]


def test_affixes(spark):
    assert column(spark, ["abcdef", "abcd", "abc", None], lambda w: W.prefixes(w, 2)) == [["a", "ab"], ["a", "ab"], [], []]
    assert column(spark, ["abcdef", "abcd"], lambda w: W.suffixes(w, 2)) == [["f", "ef"], []]


def test_other_forms(spark):
    assert column(spark, ["a1b22"], W.digits_to_zero) == ["a0b00"]
    assert column(spark, ["-LRB-", "x"], W.unescape_bracket) == ["(", "x"]
    assert column(spark, ["12345", "well-known", "-LRB-"], lambda w: W.vector_key(w, True)) == ["fifteen", "known", "("]
    assert column(spark, ["ktAb"], W.buckwalter_to_arabic) == ["كتاب"]
    assert "ProbablyYear" in column(spark, ["1984"], W.properties)[0]
    assert "ProbablyAcronym" in column(spark, ["U.S."], W.properties)[0]


def test_label_parts(spark):
    got = column(spark, ["NP-SBJ-1", "-NONE-", "S", "PRT|ADVP", ""], W.label_parts)
    assert [(g.base, g.idx, g.functions) for g in got] == [("NP", 1, ["SBJ"]), ("-NONE-", -1, []), ("S", -1, []), ("PRT", -1, []), ("TOP", -1, [])]


def test_distance_bins(spark):
    df = spark.createDataFrame([(d,) for d in range(-25, 26)], "d int")
    rows = df.select("d", maths.distance_bin(F.col("d")).alias("b"), maths.binned_distance(F.col("d")).alias("x")).collect()
    assert all((r.d > 0) - (r.d < 0) == (r.b > 0) - (r.b < 0) for r in rows)
    assert len({r.b for r in rows if r.d}) == 16
    by = {r.d: r.x for r in rows}
    assert (by[0], by[4], by[7], by[12], by[25], by[-12], by[-25]) == (0, 4, 10, 21, 21, -20, -21)


def test_log_sum(spark):
    r = spark.createDataFrame([([0.0, 0.0],), ([1000.0, 1000.0],)], "a array<double>").select(maths.log_sum_array(F.col("a"))).collect()
    assert r[0][0] == pytest.approx(0.693147, abs=1e-5) and r[1][0] == pytest.approx(1000.693147, abs=1e-5)


@pytest.mark.parametrize(
    "word,stem",
    [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"),
     ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"),
     ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("Is", "is")],
)
def test_porter(word, stem):
    assert stemming.stem(word) == stem


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("Every small dog barks well.", "Every small dog barks well ."),
        ("They can't go, cannot stay.", "They ca n't go , can not stay ."),
        ("We've seen it's Anna’s.", "We 've seen it 's Anna 's ."),
        ('"Hi you."', "`` Hi you . ''"),
        ('Hi you."', "Hi you . ''"),
        ("See (this); [that]!", "See ( this ) ; [ that ] !"),
        ("Dr. Bell saw 1,234.5 items", "Dr. Bell saw 1,234.5 items"),
        ("They like T.J.M. Works Inc.", "They like T.J.M. Works Inc. ."),
        ("Wait ... what?!", "Wait ... what ?!"),
        ("the parents' house", "the parents ' house"),
        ("o'clock at http://a.example/b?c=1.", "o'clock at http://a.example/b?c=1 ."),
        ("", ""),
    ],
)
def test_treebank(text, tokens):
    assert treebank.tokenize(text) == tokens.split()


def test_treebank_escape():
    assert treebank.escape(["(", '"', "x", '"', ")"]) == ["-LRB-", "``", "x", "''", "-RRB-"]
    assert treebank.unescape("-LSB-") == "["
