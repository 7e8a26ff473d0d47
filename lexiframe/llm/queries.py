"""Registered pN_ queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.llm import bpe, knn, overlap, packing, sentences, spam, splits, terms
from lexiframe.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "sentences"), table(spark, d, "portions"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "sentences"), table(spark, d, "portions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.groups(table(spark, d, "sentences"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_sentences(table(spark, d, "sentences"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    sentences = table(spark, d, "sentences")
    store = terms.count_terms(sentences, table(spark, d, "pos_tags"))
    n = sentences.select("sent_id").where("sent_id is not null").distinct().count()
    return terms.marks(store.counts(), n).withColumnRenamed("field", "term_field")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).where("mark is not null").select("term_field", "term", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select("term_field", "term", "n_occ", "n_rec")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "slabs"), "slab_id", "content")


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "documents"), "doc_id", "text", unique=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.found(table(spark, d, "word_vectors"))


def p2_search(spark: SparkSession, d: str) -> DataFrame:
    return knn.search(table(spark, d, "word_vectors"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack_documents(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.found(table(spark, d, "documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.scores(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_documents": p1_documents,
    "p2_found": p2_found,
    "p2_search": p2_search,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
}

_WORDS = r"""
 d AS (SELECT DISTINCT ON (sent_id) sent_id, section_id, source, words FROM sentences WHERE sent_id IS NOT NULL),
 s AS (SELECT sent_id, section_id, list_sort(list_distinct(list_filter(list_transform(words,
        lambda w: regexp_replace(lower(w), '^[\s 　]+|[\s 　]+$', '', 'g')),
        lambda w: w IS NOT NULL AND regexp_matches(w, '[\p{L}\p{N}]')))) AS words FROM d),
 sp AS (SELECT DISTINCT unnest(sections) AS section_id, portion_name AS split FROM portions),
 e AS (SELECT s.sent_id, sp.split, s.words FROM s JOIN sp USING (section_id) WHERE len(s.words) >= 10)
"""

_P5 = r"""
WITH w AS (SELECT DISTINCT ON (sent_id) sent_id, words FROM sentences WHERE sent_id IS NOT NULL AND words IS NOT NULL),
 a AS (SELECT 'word' AS term_field, sent_id AS rec, trim(lower(u.x)) AS term, 1 AS one FROM w, unnest(w.words) AS u(x)),
 t AS (SELECT DISTINCT 'tag' AS term_field, sent_id AS rec, tok_idx, trim(upper(tag)) AS term FROM pos_tags WHERE sent_id IS NOT NULL),
 both_ AS (SELECT term_field, rec, term FROM a UNION ALL SELECT term_field, rec, term FROM t),
 c AS (SELECT term_field, term, count(*) AS n_occ, count(DISTINCT rec) AS n_rec FROM both_ WHERE term IS NOT NULL AND term <> '' GROUP BY 1, 2)
"""

_USABLE = """
WITH u AS (SELECT vec_id, list_transform(vec, lambda x: x::DOUBLE) AS v FROM word_vectors
  WHERE vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0
   AND len(list_filter(vec, lambda x: x <> 0)) > 0),
 c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id),
 r AS (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM c)
"""

SQL: dict[str, str] = {
    "p2_found": _USABLE + " SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE rank <= 5 AND cosine >= 0.85",
    "p3_found": "WITH " + _WORDS + """
 SELECT DISTINCT least(a.sent_id, b.sent_id) AS sent_id_a, greatest(a.sent_id, b.sent_id) AS sent_id_b
 FROM e a JOIN e b ON a.split = 'train' AND b.split <> 'train' AND a.sent_id <> b.sent_id
  AND len(a.words) * 3 <= len(b.words) * 4 AND len(b.words) * 3 <= len(a.words) * 4
 WHERE len(list_intersect(a.words, b.words)) * 4 >= 3 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))""",
    "p3_report": "WITH " + _WORDS + """
 SELECT b.split, d.source, count(DISTINCT b.sent_id) AS n_sent, count(*) AS n_links
 FROM e a JOIN e b ON a.split = 'train' AND b.split <> 'train' AND len(a.words) * 3 <= len(b.words) * 4 AND len(b.words) * 3 <= len(a.words) * 4 JOIN d ON d.sent_id = b.sent_id
 WHERE len(list_intersect(a.words, b.words)) * 4 >= 3 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) GROUP BY 1, 2""",
    "p2_search": _USABLE + " SELECT a AS vec_id, CAST(rank AS INT) AS rank, b AS neighbour_id, cosine FROM r WHERE rank <= 5 AND a % 50 = 0",
    "p5_found": _P5 + """
 SELECT term_field, term, CASE WHEN n_rec < 3 THEN 'rare' ELSE 'common' END AS mark FROM c
 WHERE n_rec < 3 OR n_rec > 0.2 * (SELECT count(DISTINCT sent_id) FROM sentences)""",
    "p5_counts": _P5 + " SELECT term_field, term, n_occ, n_rec FROM c",
    "p4_found": """
WITH RECURSIVE held AS (
  SELECT DISTINCT docid, 's' || section_id AS key FROM sentences WHERE docid IS NOT NULL AND section_id IS NOT NULL
  UNION SELECT DISTINCT docid, 'p' || annotations.speaker FROM sentences
  WHERE docid IS NOT NULL AND annotations.speaker IS NOT NULL AND annotations.speaker NOT IN ('', '-')),
 link AS (SELECT DISTINCT a.docid AS u, b.docid AS v FROM held a JOIN held b USING (key)),
 reach(docid, other) AS (
  SELECT DISTINCT docid, docid FROM sentences WHERE docid IS NOT NULL
  UNION SELECT r.docid, l.v FROM reach r JOIN link l ON r.other = l.u)
SELECT docid, min(other) AS group_docid FROM reach GROUP BY docid""",
}
