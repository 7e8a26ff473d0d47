"""Queries that take all rows, whatever split, length or language they are of."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexiframe.plans.common import held_out, tokens
from tests.conftest import DATA


def sql_rows(name):
    con = duckdb.connect()
    for t in ("sentences", "pos_tags", "portions"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    rel = con.sql(entry.oracle_sql()[name])
    return rel.columns, set(rel.fetchall())


@pytest.mark.parametrize("name", ["hmm_viterbi", "crf_posterior", "pcfg_parse", "pcfg_max_constituent", "pcfg_kbest"])
def test_models_take_all_sentences(spark, name):
    got = entry.queries()[name](spark, DATA)
    keys = ["sent_id", "pos"] if "pos" in got.columns else ["sent_id"]
    have, want = ({tuple(r) for r in df.select(*keys).distinct().collect()} for df in (got, tokens(spark, DATA)))
    assert have == want


@pytest.mark.parametrize("name", ["gazetteer_word", "gazetteer_span", "backoff_lookup", "span_enumeration", "span_mask", "gold_segment_policy"])
def test_sql_takes_all_sentences(spark, name):
    cols, want = sql_rows(name)
    assert {tuple(r) for r in entry.queries()[name](spark, DATA).select(*cols).collect()} == want


def test_gazetteers_hit_every_sentence_they_were_made_from(spark):
    entities = entry.queries()["entity_segments"](spark, DATA).select("sent_id").distinct()
    rest = entities.join(held_out(entities, spark, DATA), "sent_id", "left_anti")
    assert rest.count() > 0 and rest.join(entry.queries()["gazetteer_span"](spark, DATA), "sent_id", "left_anti").count() == 0


def test_backoff_takes_all_words(spark):
    got, vocabulary = entry.queries()["backoff_lookup"](spark, DATA), tokens(spark, DATA).select("word").distinct()
    assert got.count() == vocabulary.count() and vocabulary.join(got, "word", "left_anti").count() == 0


@pytest.fixture(scope="session")
def long_entity(spark, tmp_path_factory):
    """One sentence of 25 words with an entity of 6 and one of 2 tokens."""
    d = str(tmp_path_factory.mktemp("long"))
    schema = "sent_id bigint, docid string, idx int, words array<string>, annotations struct<ner: array<struct<ner_type: string, span_begin: int, span_end: int>>>, section_id string, source string"
    row = (1, "d", 0, [f"w{i}" for i in range(25)], ([("ORG", 2, 8), ("GPE", 10, 12)],), None, None)
    spark.createDataFrame([row], schema).write.parquet(f"{d}/sentences.parquet")
    return d


def test_spans_have_no_fixed_length(spark, long_entity):
    q = {n: entry.queries()[n](spark, long_entity) for n in ("span_enumeration", "span_length_bins", "span_mask", "layered_span_mask")}
    want = {(1, b, e) for b in range(25) for e in range(b + 1, min(25, b + 6) + 1)}
    assert {(r.sent_id, r.begin, r.end) for r in q["span_enumeration"].collect()} == want
    bins = {r["bin"]: r.n for r in q["span_length_bins"].collect()}
    assert bins == {1: 25, 2: 24, 3: 23, 4: 22, 5: 21, 6: 90, 7: 105, 8: 15}
    assert {(r.begin, r.end) for r in q["span_mask"].collect()} == {(2, 8), (10, 12)}
    layers = {(r.label, r.len): r.n for r in q["layered_span_mask"].collect()}
    assert layers[("ORG", 1)] == 6 and layers[("ORG", 6)] == 5 and layers[("GPE", 2)] == 1 and ("GPE", 3) not in layers


def test_treebank_takes_all_languages(spark, tmp_path):
    rows = [(1, "We can't go.", "en"), (2, "We can't go.", None), (3, "We can't go.", "und"), (4, "Es regnet.", "DE"), (7, "No stop here \n\n", "th"), (5, None, "en"), (6, "  ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "string(null) source", "string(null) genre")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in entry.queries()["treebank_tokens"](spark, str(tmp_path)).orderBy("doc_id", "begin", "i").collect():
        got.setdefault(r.doc_id, []).append(r.token)
    assert got == dict.fromkeys((1, 2, 3), ["We", "ca", "n't", "go", "."]) | {4: ["Es", "regnet", "."], 7: ["No", "stop", "here"]}
