from lexiframe.operators import layers
from lexiframe.plans import text
from pyspark.sql import functions as F

DOC = "One cat sat down.  It purred loudly!\nNo end here"


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def test_sentences_and_tokens(spark):
    df = frame(spark, [(1, DOC), (2, ""), (3, None), (4, "a."), (5, "x")])
    s = {(r.doc_id, r.begin): r.sentence for r in layers.sentences(df).collect()}
    assert s == {(1, 0): "One cat sat down.", (1, 19): "It purred loudly!", (1, 44): "here", (5, 0): "x"}
    t = [r.token for r in layers.tokens(df.where("doc_id = 1")).orderBy("begin").collect()]
    assert t == ["One", "cat", "sat", "down", ".", "It", "purred", "loudly", "!", "No", "end", "here"]


def test_offsets_cover_the_text(spark):
    df = frame(spark, [(1, "Ünïcode 🎉 works. Yes it does!")])
    j = layers.spanned(layers.sentences(df).join(df, "doc_id"))
    assert j.where("covered <> sentence").count() == 0 and j.count() == 2


def test_lines(spark):
    df = frame(spark, [(1, "a line\n\nmore\n"), (2, "\n"), (3, ""), (4, "tail")])
    got = sorted((r.doc_id, r.begin, r.line) for r in layers.lines(df).collect())
    assert got == [(1, 0, "a line\n\n"), (1, 8, "more\n"), (1, 13, ""), (2, 1, ""), (3, 0, ""), (4, 0, "tail")]


def test_overlapping_spans(spark):
    rows = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (3, 4)]
    df = spark.createDataFrame(rows, "begin int, end int")
    assert [tuple(r) for r in layers.covered(df, 1, 3).collect()] == [(1, 2), (1, 3), (2, 3)]
    assert [tuple(r) for r in layers.preceding(df, 1).collect()] == [(0, 1)]
    assert [tuple(r) for r in layers.following(df, 2).collect()] == [(2, 3), (3, 4)]


def test_within_and_nearest(spark):
    inner = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 8, 9)], "doc_id bigint, begin int, end int")
    outer = spark.createDataFrame([(1, 0, 5), (1, 9, 12)], "doc_id bigint, begin int, end int")
    assert sorted((r.begin, r.outer_begin) for r in layers.within(inner, outer).collect()) == [(0, 0), (3, 0)]
    n = layers.nearest(outer, inner).orderBy("begin").collect()
    assert [(r.begin, r.preceding_end, r.following_begin) for r in n] == [(0, None, 8), (9, 9, None)]


def test_slab(spark):
    s = spark.createDataFrame([(1, "sentence", 0, 3, "abc")], "doc_id bigint, layer string, begin int, end int, payload string")
    t = spark.createDataFrame([(1, 0, 1, "a")], "doc_id bigint, begin int, end int, payload string")
    slab = layers.add_layer(s, t, "token")
    assert slab.count() == 2 and layers.remove_layer(slab, "token").count() == 1
    assert {r.layer: r.rendered for r in layers.render(slab).collect()} == {"sentence": "abc(0,3)", "token": "a(0,1)"}


def test_markup(spark):
    from lexiframe.sources import markup

    df = spark.createDataFrame([("<html><script>x<y</script><p>One &amp; <b>two</b></p><br>three</html>",), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(markup.text(F.col("h"))).collect()] == ["One & two\nthree", None, ""]


def test_empty_table(spark):
    df = frame(spark, [])
    assert layers.sentences(df).count() == layers.tokens(df).count() == layers.lines(df).count() == 0
    assert set(text.SQL) <= set(text.QUERIES)


def test_nearest_over_texts_shuffled_by_their_id(spark):
    """A sentence's next token begins where it ends or behind; the last one of a text has none."""
    rows = [(i, f"The dog {i} ran. It fell? Yes", "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra string")
    got = layers.nearest(layers.sentences(docs), layers.tokens(docs))
    assert got.where("following_begin is not null").count() == 400 and got.where("preceding_end is not null").count() == 400 and got.count() == 600


PAGE = """<html><head><title> A &amp; B </title><style>p {x: y}</style></head><body>
<ul><li><a href="/">Home</a></li><li><a href="/x">All about us and them</a></li></ul>
<h1>The bridge</h1>
<p>The old bridge was closed for repairs, and the people of the town had to walk around the lake for weeks.
<p>Nobody knew when it would be opened again, as the <a href="/c">council</a> had said nothing about the work until then.</p>
<div><a href="/1">one more story</a> | <a href="/2">and another one</a></div><p>Imprint</p><script>var a = "<p>no</p>";</script></body></html>"""


def test_main_text_and_title(spark):
    from lexiframe.sources import markup

    df = spark.createDataFrame([(PAGE,), (None,), ("",), ("plain words only",)], "h string")
    got = df.select(markup.main_text(F.col("h")).alias("m"), markup.page_title(F.col("h")).alias("t")).collect()
    lines = got[0].m.split("\n")
    assert lines[0] == "The bridge" and lines[1].startswith("The old bridge") and lines[-1].endswith("until then.") and got[0].t == "A & B"
    assert "Home" not in got[0].m and "story" not in got[0].m and got[1].m is None and got[2].m == "" and got[2].t is None


def test_xhtml_is_well_formed(spark):
    from xml.etree import ElementTree

    from lexiframe.sources import markup

    df = spark.createDataFrame([(PAGE,), (None,), ("<b>a<i>b</b>c</i><br>&lt;",), ("",)], "h string")
    got = [r[0] for r in df.select(markup.xhtml(F.col("h"))).collect()]
    for x in got:
        if x is not None:
            ElementTree.fromstring(x)
    assert got[1] is None and got[2] == "<body><b>a<i>b</i></b>c<br/>&lt;</body>"
