import json

import numpy as np
import pytest
from lexiframe.sources import columns, delimited, nested, vectors
from lexiframe.streaming import segmenter

GOOD = 'd-1,3,"Ames, Jola",A dog .,DT NN .,PERSON:0:1,(S (DT A) (NN dog) (. .))'


@pytest.mark.parametrize(
    "line,reason",
    [
        (GOOD, None), ('"d","3","x""y","a","b","",""', None), ("d,0,,a,b,,", None), ('d,0,"a\nb",a,b,,', None),
        (None, "columns"), ("", "columns"), ("a,b", "columns"), (GOOD + ",x", "columns"), ('d,1,"x" y,a,b,,', "quoting"), ('d,1,x"y",a,b,,', "quoting"), (',3,"open', "quoting"),
        ('"a"b', "quoting"), (",1,s,a,b,,", "value"), ("d,x,s,a,b,,", "value"), ("d,-1,s,a,b,,", "value"), ("d,2147483648,s,a,b,,", "value"), ("d,2147483647,s,a,b,,", None),
        ("d,1,s,a  b,x y z,,", "value"), ("d,1,s,a b,x,,", "value"), ("d,1,s,,,,", "value"), ("d,1,s,a,b,PERSON:0:2,", "value"), ("d,1,s,a,b,THING:0:1,", "value"), ("d,1,s,a,b,person:0:1,", "value"),
        ("d,1,s,a,b,DATE:1:1,", "value"), ("d,1,s,a,b,DATE:0:1 ,", "value"), ("d,1,s,a,b,WORK_OF_ART:0:1,", None), ("d,1,s,a,b,,(S (X a)", "value"), ("d,1,s,a,b,,(S) (X)", "value"), ("d,1,s,a,b,, (S)", "value"),
        (GOOD + "\r", "value"), ("d,1,s\rt,a,b,,", None), ('d,1,"s\r\nt",a,b,,', None), ("x\n0,EVIL,9,sp,a b,N V,,", "columns"), ("d,1,s\nt,a,b,,", None), ("d,1,s\x00,a,b,,", None),
        ("\r\n", "columns"), ('d,1,"\r",a,b,,\n', "value"), ("d,1,\x01\x02,a,b,,", None), ("d,1,\ue000\r,a,b,,", None), ("d,1," + "long " * 700_000 + ",a,b,,", None),
        ("d,1,s,a,b,,x", "value"), ("d,00000000000000000001,s,a,b,,(S)", None),
    ],
)
def test_reasons(line, reason):
    got = delimited.judge([GOOD, line, GOOD], delimited._Reader())
    assert [g[0] for g in got] == [None, reason, None]


def test_breaks_come_back_and_nothing_moves():
    lines = [GOOD, 'd,1,"a\r\nb\x00",w,t,,', "x\n0,EVIL,9,sp,a b,N V,,", "e,2,s\rt\ue000,w,t,,"]
    got = delimited.judge(lines, delimited._Reader())
    assert [g[1] and (g[1][0], g[1][2]) for g in got] == [("d-1", "Ames, Jola"), ("d", "a\r\nb\x00"), None, ("e", "s\rt\ue000")]


def test_a_failing_reader_is_survived():
    class Failing(delimited._Reader):
        def _scan(self, records):
            if any("bad" in r for r in records):
                raise RuntimeError("no")
            return super()._scan(records)

    lines = [GOOD, "bad,1,s,a,b,,", GOOD, "bad,1", 'bad,"x"y', GOOD]
    assert [g[0] for g in delimited.judge(lines, Failing())] == [None, None, None, "columns", "quoting", None]


@pytest.mark.parametrize("line", ["", "a", 'a,"b,c",d', '"x""y",,', ',,"', 'a"b', '"a"b,c', '"",""'])
def test_split_fields_reads_back(line):
    import csv

    got = delimited.split_fields(line)
    if got is not None and line:
        assert list(got) == next(csv.reader([line], strict=True))


def test_rows(spark):
    df = spark.createDataFrame([(1, "f", GOOD, 0), (2, "f", GOOD, 1), (3, "f", "bad", 2)], "row_id bigint, file_name string, line_text string, reason int")
    assert [tuple(r) for r in delimited.rejects(df).collect()] == [(3, "columns")]
    v = delimited.valid(df).orderBy("row_id").collect()
    assert len(v) == 2 and v[0].words == ["A", "dog", "."] and v[0].ner[0].span_end == 1 and v[0].speaker == "Ames, Jola"
    assert delimited.rejects(df.limit(0)).count() == 0


def test_nested(spark):
    node = {"id": "n0"}
    deep = node
    for i in range(1, 16):
        deep["nodes"] = {"id": f"n{i}"} if i % 2 else [{"id": f"n{i}"}]
        deep = deep["nodes"] if i % 2 else deep["nodes"][0]
    body = {
        "doc": "d",
        "layers": {"id": "L", "regions": [{"id": "r", "anchors": "0 3"}, {"id": "q", "start": "4", "end": 9}], "nodes": [node, None, 5],
                   "annotations": [{"id": "a", "ref": "lost", "features": {"k": None, "v": 1}}, {"id": "b", "features": [{"name": "x", "value": 1}]}],
                   "edges": {"id": "e", "from": "n0"}},
    }
    deep["annotations"] = [{"id": "c", "ref": "", "features": {"f": {"name": "y", "value": []}}}, {"id": "g", "features": {"name": "z", "value": 2}}]
    rows = [(1, json.dumps(body)), (1, json.dumps(body)), (2, None), (3, ""), (4, "{}"), (5, "{broken"), (6, "[]"), (7, '{"layers": []}')]
    df = spark.createDataFrame(rows, "rec_id bigint, body string")
    got = sorted((r.obj_kind, r.child_id, r.parent_id) for r in nested.links(df).collect())
    want = [("annotation", "a", "lost"), ("annotation", "b", None), ("annotation", "c", "n15"), ("annotation", "g", "n15"), ("edge", "e", "n0"), ("feature", "k", "a"), ("feature", "v", "a"), ("feature", "x", "b"),
            ("feature", "y", "c"), ("feature", "z", "g"), ("layer", "L", "d"), ("region", "q", "L"), ("region", "r", "L"), ("node", "n0", "L"), *[("node", f"n{i}", f"n{i - 1}") for i in range(1, 16)]]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    o = nested.objects(df)
    assert {(r.region_id, r.start, r.end) for r in nested.regions(o).collect()} == {("r", 0, 3), ("q", 4, 9)}
    assert nested.features(o).count() == 5 and nested.edges(o).first().to_id is None
    assert nested.links(df.limit(0)).count() == 0


def test_columns(spark):
    text = "#begin doc\nEU X B\nis Y O\n\n\nok Z O\n#end doc\nout W O\n"
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text.split("\n"))], "file string, line_no int, text string")
    d = columns.documents(lines)
    e = columns.examples(d).orderBy("id").collect()
    assert [(r.id, r.words, r.labels) for r in e] == [("f-0", ["EU", "is"], ["B", "O"]), ("f-1", ["ok"], ["O"])]
    cells = spark.createDataFrame([(1, 0, "(A(B*"), (1, 1, "*)"), (1, 2, "(C*))")], "s int, pos int, cell string")
    assert {(r.label, r.begin, r.end) for r in columns.bracket_spans(cells, ["s"]).collect()} == {("A", 0, 3), ("B", 0, 2), ("C", 2, 3)}


def test_vectors(spark, tmp_path):
    lines = spark.createDataFrame([("2 3",), ("a 1 2 3",), ("b\t4\t5\t6",), ("c 1 x 2",), ("",)], "value string")
    v = vectors.from_lines(lines)
    assert {r.word: r.vec for r in v.collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    m = vectors.merge([(v.where("word = 'a'"), 3), (v.where("word = 'b'"), 3)])
    assert {r.word: r.vec for r in m.collect()} == {"a": [1, 2, 3, 0, 0, 0], "b": [0, 0, 0, 4, 5, 6]}
    data = b"2 2\n" + b"".join(w + b" " + np.array(x, "<f4").tobytes() + b"\n" for w, x in ((b"p", [1, 2]), (b"q", [3, 4])))
    (tmp_path / "v.bin").write_bytes(data)
    assert {r.word: r.vec for r in vectors.read_binary(spark, str(tmp_path / "v.bin")).collect()} == {"p": [1, 2], "q": [3, 4]}
    vocab = spark.createDataFrame([("a",), ("z",)], "word string")
    c = {r.word: len(r.vec) for r in vectors.complete(v, vocab, 3).collect()}
    assert c == {"a": 3, "b": 3, "z": 3}


def test_stream_cut():
    said, rest = segmenter.cut("One here. Two is", False)
    assert said == ["One here."] and rest == " Two is"
    assert segmenter.cut(rest + " done! x", True)[0] == ["Two is done!", "x"]
