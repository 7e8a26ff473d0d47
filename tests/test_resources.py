"""Corpora in files, line-based resources, stores, bit sets, navigation and the trained segmenter."""

import pytest
from lexiframe.functions import names
from lexiframe.operators import boundary, layers, masks, navigation, trees
from lexiframe.operators.treebank import tokenize
from lexiframe.sources import conll, lists, standoff, treebanks
from pyspark.sql import functions as F

TREE = "(TOP (S (NP (DT The) (NN dog)) (VP (VBD ran)) (. .)))"


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_pieces():
    assert treebanks.pieces("( (S (A a)\n (B b)) ) x (C\nc)(D d") == ["( (S (A a)\n (B b)) )", "(C\nc)"]
    assert treebanks.pieces("") == [] and treebanks.pieces(") (A a)") == ["(A a)"]


def test_layouts(spark, tmp_path):
    for section, n in (("02", 2), ("21", 1), ("22", 1), ("23", 1), ("00", 1)):
        put(tmp_path / "wsj" / section / f"wsj_{section}.mrg", (TREE.replace("TOP", "") + "\n") * n)
    p = treebanks.treebank(spark, str(tmp_path / "wsj"), "penn")
    assert sorted((r.split, r.i) for r in p.collect()) == [("dev", 0), ("test", 0), ("train", 0), ("train", 0), ("train", 1)]
    for n in (5, 272, 303, 700, 999, 390):
        put(tmp_path / "ctb" / f"chtb_{n:03d}.mrg", TREE)
    c = treebanks.treebank(spark, str(tmp_path / "ctb"), "chinese")
    assert sorted(r.split for r in c.collect()) == ["dev", "test", "train", "train", "train"]
    for k in (1, 2, 3):
        put(tmp_path / "neg" / f"negra_{k}.mrg", TREE.replace("dog", "Häuser"), "iso8859-1")
    g = treebanks.treebank(spark, str(tmp_path / "neg"), "negra").collect()
    assert {r.split for r in g} == {"train", "dev", "test"} and all("Häuser" in r.tree for r in g)
    put(tmp_path / "spm" / "train5k" / "a.ptb", TREE)
    put(tmp_path / "spm" / "dev" / "a.ptb", TREE)
    assert {r.split for r in treebanks.treebank(spark, str(tmp_path / "spm"), "spmrl").collect()} == {"train", "dev"}
    put(tmp_path / "spm" / "train" / "b.ptb", TREE * 3)
    assert treebanks.treebank(spark, str(tmp_path / "spm"), "spmrl").where("split = 'train'").count() == 3
    assert treebanks.treebank(spark, str(tmp_path / "spm"), "spmrl5k").where("split = 'train'").count() == 1
    put(tmp_path / "meta" / "test" / "x" / "a.parse", TREE)
    assert [r.split for r in treebanks.treebank(spark, str(tmp_path / "meta"), "meta").collect()] == ["test"]


def test_processing(spark, tmp_path):
    rows = [("f", i, "train" if i < 20 else "test", TREE if i % 2 else "(TOP (S (NP (NN x))))") for i in range(25)] + [("f", 30, "train", None), ("f", 31, "train", "(broken")]
    df = spark.createDataFrame(rows, "file string, i int, split string, tree string")
    cut = treebanks.cut_by_order(df.where("tree is not null"))
    assert {(r.split, r.n) for r in cut.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {("train", 18), ("dev", 3), ("test", 5)}
    p = treebanks.processed(df, longest=2)
    assert p.where("split = 'train'").count() == 10 and p.where("tree like '%+%'").count() > 0
    assert treebanks.processed(df.withColumn("split", F.lit("dev")), dev_in_train=True, first=4).where("split = 'train'").count() == 4
    b = treebanks.processed(spark.createDataFrame([("f", 0, "test", "(TOP (NP (NN ktAb)))")], df.schema), debuckwalter=True, fold_unaries=False).first().tree
    assert "كتاب" in b
    treebanks.write(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 25
    pairs = spark.createDataFrame([(TREE, TREE)], "gold string, guess string")
    assert treebanks.bucketed(pairs, 2).first().bucket == 4 and treebanks.bucketed(pairs, 2, True).first().bucket == 2


COREF = """#begin document (d); part 000
d 0 0 The DT (TOP(S(NP* the - - ann * (ARG0* (3
d 0 1 dog NN *) dog - - ann * *) 3)
d 0 2 saw VBD (VP* see 01 1 - * (V*) -
d 0 3 Bo NNP (NP*) Bo - - - (PERSON) (ARG1*) (3)|(4
d 0 4 Hill NNP *))) Hill - - - * * 4)

d 0 0 Go VB (TOP*) go - - - * -

#end document
#begin document (d); part 001
d 1 0 Yes UH (TOP*) yes - - - * -
#end document
"""


def test_coreference_columns(spark, tmp_path):
    put(tmp_path / "x.conll", COREF)
    t = conll.tokens(conll.lines(spark, str(tmp_path))).cache()
    s = {(r.doc_id.rsplit("-", 1)[1], r.sent): r for r in conll.sentences(t).collect()}
    assert set(s) == {("0", 0), ("0", 1), ("1", 0)} and s["0", 0].words == ["The", "dog", "saw", "Bo", "Hill"] and s["0", 0].speaker == "ann" and s["0", 1].speaker is None
    assert trees.render(trees.read(s["0", 0].tree)) == "(TOP (S (NP (DT The) (NN dog)) (VP (VBD saw) (NP (NNP Bo)) (NNP Hill))))"
    assert [(r.label, r.begin, r.end) for r in conll.entities(t).collect()] == [("PERSON", 3, 4)]
    assert sorted((r.entity, r.begin, r.end) for r in conll.mentions(t).collect()) == [(3, 0, 2), (3, 3, 4), (4, 3, 5)]
    a = conll.arguments(t)
    assert sorted((r.label, r.begin, r.end, r.verb, r.sense, r.lemma) for r in a.collect()) == [("ARG0", 0, 2, 2, 1, "see"), ("ARG1", 3, 4, 2, 1, "see")]
    more = a.unionByName(a.where("label = 'ARG0'").withColumn("label", F.lit("IN")).withColumn("end", F.lit(1)))
    n = conll.sentences(t).select("doc_id", "sent", F.size("words").alias("n"))
    got = conll.argument_segments(more, n).orderBy("begin").collect()
    assert [(r.label, r.begin, r.end) for r in got] == [("ARG0", 0, 2), ("O", 2, 3), ("ARG1", 3, 4), ("O", 4, 5)]


XML = '<graph xmlns="http://x" xmlns:xml="http://www.w3.org/XML/1998/namespace">{}</graph>'


def test_standoff_xml(spark, tmp_path):
    put(tmp_path / "a" / "d.txt", "Ann saw Bo Hill. Go.")
    put(tmp_path / "a" / "d-s.xml", XML.format('<region xml:id="s0" anchors="0 16"/><region xml:id="s1" anchors="17 20"/>'))
    spans = [(0, 3), (4, 7), (8, 10), (11, 15), (15, 16), (17, 19), (19, 20)]
    put(tmp_path / "a" / "d-seg.xml", XML.format("".join(f'<region xml:id="g{i}" anchors="{b} {e}"/>' for i, (b, e) in enumerate(spans))))
    nodes = "".join(f'<node xml:id="p{i}"><link targets="g{i}"/></node><a xml:id="pa{i}" label="tok" ref="p{i}" as="x"><fs><f name="msd" value="T{i}"/></fs></a>' for i in range(7))
    put(tmp_path / "a" / "d-penn.xml", XML.format(nodes))
    ne = '<node xml:id="n0"/><edge xml:id="e0" from="n0" to="p2"/><edge xml:id="e1" from="n0" to="p3"/><a xml:id="x" label="person" ref="n0"/><node xml:id="n1"/><edge xml:id="e2" from="n1" to="p0"/><a xml:id="y" label="misc" ref="n1"/>'
    put(tmp_path / "a" / "d-ne.xml", XML.format(ne))
    put(tmp_path / "a" / "broken-ne.xml", "<graph>")
    o = standoff.objects(spark, str(tmp_path)).cache()
    assert sorted((r.begin, r.end, r.label) for r in standoff.entities(o).collect()) == [(0, 3, "misc"), (8, 15, "person")]
    got = standoff.aligned(o, standoff.texts(spark, str(tmp_path))).orderBy("begin").collect()
    assert [(r.sent_begin, r.pos, r.token, r.tag, r.bio) for r in got] == [
        (0, 0, "Ann", "T0", "O"), (0, 1, "saw", "T1", "O"), (0, 2, "Bo", "T2", "B-PER"), (0, 3, "Hill", "T3", "I-PER"), (0, 4, ".", "T4", "O"), (17, 0, "Go", "T5", "O"), (17, 1, ".", "T6", "O"),
    ]
    pos = spark.createDataFrame([({"kind": "urlAddress"},), ({"categor": "JJ"},), ({},)], "f map<string,string>").select(standoff.tag_of(F.col("f")).alias("t"))
    assert [r.t for r in pos.collect()] == ["URL", "JJ", "UNK"]


def test_lists(spark, tmp_path):
    text = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    assert [(r.type, r.words) for r in lists.gazetteer(text("LOC New York", "PER", "", None)).collect()] == [("LOC", ["New", "York"])]
    c = lists.clusters(text("0101\tdog\t5", "11\tcat\t1", "0110101011011\tx9\t7", "bad")).cache()
    assert {(r.word, r.cluster) for r in c.collect()} == {("dog", "0101"), ("x9", "0110101011011")}
    assert {r.word for r in lists.with_digit_forms(c).collect()} == {"dog", "x9", "x1"}
    assert c.where("word = 'x9'").select(lists.cluster_prefixes(F.col("cluster")).alias("p")).first().p == ["0110101", "01101010110", "0110101011011"]
    w = spark.createDataFrame([("a\tb", 0.5), ("tiny", 1e-5), ("c", -2.0)], "feature string, weight double")
    lists.write_weights(w, str(tmp_path / "w"))
    assert {(r.feature, r.weight) for r in lists.read_weights(spark, str(tmp_path / "w")).collect()} == {("a\tb", 0.5), ("c", -2.0)}
    rules = spark.createDataFrame([("binary", "S", "NP VP", -0.5), ("root", "", "S", 0.0)], "kind string, parent string, children string, logp double")
    lists.write_grammar(rules, str(tmp_path / "g"))
    back = lists.read_grammar(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rules.collect()}
    assert lists.signature(back).first().md5 == lists.signature(rules.orderBy(F.desc("kind"))).first().md5
    s = lists.state_rules(text("NP_0 DT_1 NN_0 0.5", "NP_1 DT_0 NN_0 0.25", "X_0 Y_0 Z_0 1e-9"), text("ROOT_0 S_0 1.0", "PRT|ADVP_2 RP_0 0.1"))
    assert {(r.kind, r.parent, r.children, r.n) for r in lists.project_states(s).collect()} == {("binary", "NP", "DT NN", 2), ("unary", "TOP", "S", 1), ("unary", "PRT", "RP", 1)}


def test_vector_options(spark, tmp_path):
    import numpy as np
    from lexiframe.sources import vectors

    data = b"2 3\n" + b"dog " + np.array([1, 2, 3], "<f4").tobytes() + b"\ncat " + np.array([4, 5, 6], "<f4").tobytes()
    (tmp_path / "v.bin").write_bytes(data)
    words = spark.createDataFrame([("cat",), ("cow",), ("cat",)], "word string")
    assert [(r.word, r.vec) for r in vectors.read_binary(spark, str(tmp_path / "v.bin"), words, bias=True).collect()] == [("cat", [4.0, 5.0, 6.0, 1.0])]
    a = spark.createDataFrame([("x", [1.0, 2.0])], "word string, vec array<float>")
    b = spark.createDataFrame([("y", [3.0])], "word string, vec array<float>")
    assert {r.word: r.vec for r in vectors.merge([(a, 2), (b, 1)], longest=2).collect()} == {"x": [1.0, 2.0], "y": [0.0, 0.0]}
    drawn = {r.word: r.vec for r in vectors.merge([(a, 2), (b, 1)], draw=True).collect()}
    assert drawn["x"][:2] == [1.0, 2.0] and drawn["y"][2] == 3.0 and all(-1 <= v <= 1 and v != 0 for v in [drawn["x"][2], *drawn["y"][:2]])


def test_store(spark, tmp_path):
    store = lists.ModelStore(spark, str(tmp_path / "models"))
    assert store.find("tag") is None
    store.save("b", "tag", "de", {"t": spark.range(3)})
    store.save("a", "tag", "en", {"t": spark.range(2), "u": spark.range(1)}, note=1)
    store.save("a", "tag", "en", {"t": spark.range(4)})
    assert store.find("tag", "de")["name"] == "b" and store.find("tag")["name"] == "a" and store.find("parse") is None
    assert store.load("a")["t"].count() == 4


def test_bit_sets(spark):
    a = spark.createDataFrame([(1, 0), (1, 63), (1, 64), (2, 200), (3, -1), (3, None)], "sent_id int, pos int")
    b = spark.createDataFrame([(1, 63), (1, 130), (4, 5)], "sent_id int, pos int")
    count = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.bit_count(x))
    got = {r.sent_id: tuple(r)[1:] for r in masks.combine(masks.bit_sets(a), masks.bit_sets(b)).select("sent_id", *[count(c) for c in ("both", "either", "first_only", "one_only")]).collect()}
    assert got == {1: (1, 4, 2, 3), 2: (0, 1, 1, 1), 4: (0, 1, 0, 1)}


def test_bloom(spark):
    some = spark.range(500).select(F.concat(F.lit("w"), "id").alias("w"))
    other = spark.range(500, 900).select(F.concat(F.lit("w"), "id").alias("w"))
    f = masks.unite(masks.bloom(some.where("hash(w) % 2 = 0"), "w", 8192, 3), masks.bloom(some.where("hash(w) % 2 <> 0"), "w", 8192, 3))
    assert masks.bloom_hits(some, "w", f, 8192, 3).where("not hit").count() == 0
    assert masks.bloom_hits(other, "w", f, 8192, 3).where("hit").count() < 30
    assert abs(masks.approximate_size(f, 8192, 3).first().n_values - 500) < 40
    assert masks.bloom_hits(some, "w", masks.bloom(some.limit(0), "w", 8192, 3), 8192, 3).where("hit").count() == 0


def test_navigation(spark):
    n = trees.node_table(spark.createDataFrame([(1, TREE)], "sent_id bigint, tree string"))
    got = {r.node: (r.up, r.left, r.right, r.down, r.next) for r in navigation.neighbours(n).collect()}
    assert got[0] == (None, None, None, 1, 1) and got[2] == (1, None, 5, 3, 3) and got[3] == (2, None, 4, None, 4) and got[7] == (1, 5, None, None, None)
    assert [navigation.node_heads(trees.read(TREE))[k][2] for k in (0, 1, 2, 5)] == ["ran", "ran", "dog", "ran"]


@pytest.mark.parametrize(
    "tree,want",
    [
        ("(SBARQ (WHNP-1 (WP What)) (SQ (VBD did) (NP (PRP he)) (VP (VB see) (NP (-NONE- *T*-1)))))", "(SBARQ (WHNP (WP What)) (SQ/NP (VBD did) (NP (PRP he)) (VP/NP (VB see))))"),
        ("(S (NP-SBJ-2 (NN x)) (VP (VBD ran) (S (NP (-NONE- *-2)) (VP (TO to) (VB y)))))", "(S (NP (NN x)) (VP/NP (VBD ran) (S/NP (VP (TO to) (VB y)))))"),
        ("(S (NP (-NONE- *)) (VP (VB go)))", "(S (VP (VB go)))"),
        (TREE, TREE),
    ],
)
def test_slash_categories(tree, want):
    assert trees.render(navigation.slash_categories(trees.read(tree))) == want


def test_deep_trees():
    deep = "(A " * 5000 + "(NN x)" + ")" * 5000
    t = trees.read(deep)
    assert len(trees.spans(t)) == 5001 and trees.render(t) == deep and trees.leaves(t) == [("NN", "x")]
    assert trees.render(trees.expand_unaries(trees.debinarize(trees.binarize(trees.collapse_unaries(t), trees.head_child)))) == deep
    assert trees.dependencies(t) == [(0, 1, "ROOT")] and trees.standardize(t) == ("A", [("NN", "x")])
    assert trees.read("(A x (B y))") is None and trees.read("(A x y)") is None


@pytest.mark.parametrize("tree,head", [("(TOP (S (X a)) (SINV (X b)))", 0), ("(WHADJP (WRB a) (JJ b) (WRB c))", 2), ("(NML (NN a) (NN b) (CC c))", 1), ("(NP (CD a) (PRN b))", 0), ("(@NP (@NP (NN a)) (NN b))", 0), ("(FRAG (NP a) (VP b) (VP c))", 2), ("(VP (AUX a) (VP b))", 0)])
def test_head_rules(tree, head):
    assert trees.head_child(trees.read(tree)) == head


def test_names(spark):
    v = spark.createDataFrame([("work_of_art",), ("WorkOfArt",), ("gpe ",), ("thing",), (None,)], "t string").select(names.ner_type(F.col("t")).alias("x"))
    assert [r.x for r in v.collect()] == ["WORK_OF_ART", "WORK_OF_ART", "GPE", None, None]
    m = spark.createDataFrame([("Case=Nom|Num=Sg|x|Case=Acc",), ("_",), (None,)], "t string").select(names.morph_bits(F.col("t")).alias("x"))
    assert [r.x for r in m.collect()] == [{"Case": "Nom", "Num": "Sg", "x": "true"}, {}, None]
    assert names.char_name("a") == "LATIN SMALL LETTER A" and names.char_name("\n") == "U+000A"
    assert [r.x for r in spark.createDataFrame([("appos head",), ("ident",), ("?",)], "t string").select(names.mention_type(F.col("t")).alias("x")).collect()] == ["APPOS_HEAD", "IDENT", None]


def test_covering_of_overlapping_regions(spark):
    s = "doc_id int, begin int, end int"
    outer = spark.createDataFrame([(1, 0, 1000), (1, 2, 4), (1, 0, 2), (2, 0, 9), (1, 2, 4)], s)
    inner = spark.createDataFrame([(1, 2, 3), (1, 600, 700), (1, 999, 1001), (3, 0, 1)], s)
    got = sorted((r.begin, r.outer_begin, r.outer_end) for r in layers.covering(inner, outer).collect())
    assert got == [(2, 0, 1000), (2, 2, 4), (600, 0, 1000)]


def test_pattern_matches(spark):
    df = spark.createDataFrame([(1, "a1 bb22c3"), (2, None), (3, ""), (4, "none")], "doc_id int, text string")
    assert sorted((r.doc_id, r.begin, r.end, r.token) for r in layers.matches(df, "[0-9]+").collect()) == [(1, 1, 2, "1"), (1, 5, 7, "22"), (1, 9, 10, "3")]


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("they'd told 'em.", "they 'd told 'em ."), ("donne-le", "donne -le"), ("Zrobiłbym, byliśmy", "Zrobił by m , byli śmy"), ("d'ye 'Tis", "d' ye 'T is"), ("see 10.0.0.1 file://[::1]/x", "see 10.0.0.1 file://[::1]/x"),
        ("self-\nmade XD <3", "self-made XD <3"), ("rock'n'roll O'Brien", "rock'n'roll O'Brien"),
    ],
)
def test_more_tokens(text, tokens):
    assert tokenize(text) == tokens.split()


def test_boundary_candidates_and_snapping():
    text = "It's 3,5 km. He said: “No!” Then\nHe left"
    at = boundary.candidates(text)
    assert text[at[-1]] == "t" and at[-1] == len(text) - 1 and {text[i] for i in at} >= {".", ":", "“", "!", "”", "\n"} and text.index("'") not in at and text.index(",") not in at
    assert boundary.snap(text, [text.index(".") + 1, len(text)]) == {text.index("."), len(text) - 1}
    assert boundary.candidates("") == [] and boundary.candidates("a") == [0]
    assert len(boundary.features(text, at[0])) > 20


def test_trained_segmenter(spark):
    texts = [f"The dog {v} the {n}. Dr. Fox {v} it. Was it a {n}? " for v in ("saw", "ate", "left") for n in ("cat", "hen", "owl", "cow")]
    rows = []
    for i, t in enumerate(texts * 4):
        t = t.strip()
        rows.append((i, t, [t.index(".") + 1, t.index("it.") + 3, len(t)]))
    df = spark.createDataFrame(rows, "id int, text string, ends array<int>")
    w = boundary.fit(boundary.rows(df, "id", "text", "ends"), 8)
    got = boundary.split(df.unionByName(spark.createDataFrame([(900, "   ", None), (901, None, None)], df.schema)), w, "id", "text")
    one = [rows[0][1][r.begin : r.end].strip() for r in got.where("id = 0").orderBy("begin").collect()]
    assert one == ["The dog saw the cat.", "Dr. Fox saw it.", "Was it a cat?"] and got.where("id >= 900").count() == 0


def test_command_line(spark, tmp_path):
    from lexiframe.__main__ import lines_of

    docs = spark.createDataFrame([("d", "The dog\nran. It can't stop! "), ("e", None)], "doc_id string, text string")
    assert [r.value for r in lines_of(docs, "segment").orderBy("begin").collect()] == ["The dog ran.", "It can't stop!"]
    assert [r.value for r in lines_of(docs, "tokenize").orderBy("begin").collect()] == ["The dog ran .", "It ca n't stop !"]
    from tests.conftest import DATA

    assert lines_of(docs, "tags", DATA).where("value like '%/%'").count() == 2
