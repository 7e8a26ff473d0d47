import datetime

from lexiframe.llm import terms

ENTRY = "field string, rec bigint, term string, occ bigint"


def counts(store):
    return {(r.field, r.term): (r.n_occ, r.n_rec) for r in store.counts().collect()}


def test_deltas(spark):
    frame = lambda rows: spark.createDataFrame(rows, ENTRY)
    store = terms.TermStore(spark).apply(frame([("w", 1, "a", 2), ("w", 1, "b", 1), ("w", 2, "a", 1), ("w", 3, "c", 5)]))
    assert counts(store) == {("w", "a"): (3, 2), ("w", "b"): (1, 1), ("w", "c"): (5, 1)}
    # 1 comes again unchanged, 2 changes, 3 is deleted, 4 is new
    gone = spark.createDataFrame([("w", 3), ("w", 99)], "field string, rec bigint")
    store.apply(frame([("w", 1, "a", 2), ("w", 1, "b", 1), ("w", 2, "d", 4), ("w", 4, "a", 1)]), gone)
    assert counts(store) == {("w", "a"): (3, 2), ("w", "b"): (1, 1), ("w", "d"): (4, 1)}
    again = terms.TermStore(spark, store.path)
    assert counts(again) == counts(store)
    again.apply(frame([("w", 3, "c", 1)]))
    assert counts(again)["w", "c"] == (1, 1)
    assert counts(terms.TermStore(spark).apply(frame([]))) == {}


def test_emptied_records_and_unfinished_versions(spark):
    frame = lambda rows: spark.createDataFrame(rows, ENTRY)
    names = lambda rows: spark.createDataFrame(rows, "field string, rec bigint")
    store = terms.TermStore(spark).apply(frame([("w", 1, "a", 2), ("w", 2, "a", 1)]))
    store.apply(frame([("w", 2, "b", 1)]), records=names([("w", 1), ("w", 2), ("w", 3)]))
    assert counts(store) == {("w", "b"): (1, 1)}
    # a writer that stops before its manifest is renamed leaves the version before
    store._write_manifest = lambda: None
    store.apply(frame([("w", 9, "z", 1)]))
    assert counts(terms.TermStore(spark, store.path)) == {("w", "b"): (1, 1)}


def test_entries_and_marks(spark):
    t0 = datetime.datetime(2024, 1, 1)
    late = t0 + datetime.timedelta(days=20)
    rows = [(1, ["The", " the ", "", None, "dog"], t0, t0), (1, ["The", " the ", "", None, "dog"], t0, late), (2, ["the"], t0, late), (3, ["the", "x"], t0, None), (4, None, t0, t0), (None, ["y"], t0, t0)]
    s = spark.createDataFrame(rows, "sent_id bigint, words array<string>, annotated_at timestamp, loaded_at timestamp")
    g = spark.createDataFrame([(1, 0, "dt"), (1, 0, "DT "), (1, 1, "NN"), (2, 0, None), (2, 1, ""), (None, 0, "DT")], "sent_id bigint, tok_idx int, tag string")
    store = terms.count_terms(s, g)
    assert counts(store) == {("word", "the"): (4, 3), ("word", "dog"): (1, 1), ("word", "x"): (1, 1), ("tag", "DT"): (1, 1), ("tag", "NN"): (1, 1)}
    m = {(r.field, r.term): r.mark for r in terms.marks(store.counts(), 4).collect()}
    assert m["word", "the"] == "common" and m["word", "dog"] == "rare"
