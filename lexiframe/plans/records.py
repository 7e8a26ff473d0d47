"""Queries over raw rows and nested records (problems 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.session import table
from lexiframe.sources import delimited, nested


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return delimited.rejects(table(spark, d, "raw_rows"))


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    return delimited.valid(table(spark, d, "raw_rows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.links(table(spark, d, "masc_records"))


def _flat(make, *kinds: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return make(nested.objects(table(spark, d, "masc_records"), kinds))

    return run


QUERIES = {
    "p6_found": p6_found,
    "p6_loaded": p6_loaded,
    "p7_found": p7_found,
    "p7_layers": _flat(nested.layers, "layer"),
    "p7_regions": _flat(nested.regions, "region"),
    "p7_nodes": _flat(lambda o: nested.nodes(o).withColumn("targets", F.array_join("targets", " ")), "node"),
    "p7_annotations": _flat(nested.annotations, "annotation"),
    "p7_features": _flat(nested.features, "annotation"),
    "p7_edges": _flat(nested.edges, "edge"),
}

_ROWS = r"""
WITH l AS (SELECT row_id, coalesce(line_text, '') AS line FROM raw_rows),
 q AS (SELECT row_id, line, regexp_full_match(line, '(?:"[^"]*(?:""[^"]*)*"|[^",]*)(?:,(?:"[^"]*(?:""[^"]*)*"|[^",]*))*') AS quoted,
   list_transform(regexp_extract_all(',' || line, ',("[^"]*(?:""[^"]*)*"|[^",]*)', 1), lambda f: CASE WHEN f LIKE '"%' THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) AS f FROM l),
 v AS (SELECT *, string_split(f[4], ' ') AS w, string_split(f[5], ' ') AS t, CASE WHEN f[6] = '' THEN [] ELSE string_split(f[6], ' ') END AS n,
   regexp_replace(f[7], '[^()]', '', 'g') AS b FROM q WHERE quoted AND len(f) = 7),
 j AS (SELECT row_id, f[1] <> '' AND regexp_full_match(f[2], '[0-9]+') AND coalesce(try_cast(f[2] AS HUGEINT) <= 2147483647, false)
   AND NOT list_contains(w, '') AND NOT list_contains(t, '') AND len(w) = len(t)
   AND len(list_filter(n, lambda e: NOT (regexp_full_match(e, '(CARDINAL|DATE|EVENT|FAC|GPE|LANGUAGE|LAW|LOC|MONEY|NORP|ORDINAL|ORG|PERCENT|PERSON|PRODUCT|QUANTITY|TIME|WORK_OF_ART):[0-9]+:[0-9]+')
     AND coalesce(try_cast(string_split(e, ':')[2] AS HUGEINT) < try_cast(string_split(e, ':')[3] AS HUGEINT) AND try_cast(string_split(e, ':')[3] AS HUGEINT) <= len(w), false)))) = 0
   AND (f[7] = '' OR f[7] LIKE '(%' AND f[7] LIKE '%)' AND length(replace(b, '(', '')) * 2 = length(b)
     AND len(list_filter(range(1, length(b)), lambda i: length(replace(left(b, i), ')', '')) <= length(replace(left(b, i), '(', '')))) = 0) AS ok FROM v)
"""

_RECORDS = r"""
WITH RECURSIVE r AS (SELECT DISTINCT ON (rec_id) rec_id, body::JSON AS b FROM masc_records WHERE rec_id IS NOT NULL AND trim(body) <> '' AND json_valid(body)),
 lay AS (SELECT rec_id, b->>'$.doc' AS doc, unnest({layers}) AS o FROM r),
 l AS (SELECT rec_id, doc, o, o->>'$.id' AS id FROM lay WHERE json_type(o) = 'OBJECT'),
 node(rec_id, layer, parent, o) AS (
  SELECT rec_id, id, id, unnest({nodes}) FROM l
  UNION ALL SELECT rec_id, layer, o->>'$.id', unnest({nodes}) FROM node WHERE json_type(o) = 'OBJECT'),
 n AS (SELECT rec_id, layer, parent, o, o->>'$.id' AS id FROM node WHERE json_type(o) = 'OBJECT'),
 ann0 AS (SELECT rec_id, layer, id AS parent, unnest({annotations}) AS o FROM n UNION ALL SELECT rec_id, id, NULL, unnest({annotations}) FROM l),
 a AS (SELECT rec_id, layer, CASE WHEN o->>'$.ref' <> '' THEN o->>'$.ref' ELSE parent END AS ref, o, o->>'$.id' AS id FROM ann0 WHERE json_type(o) = 'OBJECT'),
 g AS (SELECT rec_id, id AS layer, o FROM (SELECT rec_id, id, unnest({regions}) AS o FROM l) WHERE json_type(o) = 'OBJECT'),
 e AS (SELECT rec_id, id AS layer, o FROM (SELECT rec_id, id, unnest({edges}) AS o FROM l) WHERE json_type(o) = 'OBJECT'),
 f0 AS (SELECT rec_id, id, o->'$.features' AS x FROM a),
 f1 AS (SELECT rec_id, id, CASE WHEN json_type(x) = 'OBJECT' AND json_keys(x) = ['f'] AND json_type(x->'$.f') IN ('ARRAY', 'OBJECT') THEN x->'$.f' ELSE x END AS x FROM f0),
 f2 AS (SELECT rec_id, id, x, CASE WHEN json_type(x) = 'ARRAY' THEN 'array' WHEN json_type(x) = 'OBJECT' AND list_sort(json_keys(x)) = ['name', 'value'] THEN 'pair' WHEN json_type(x) = 'OBJECT' THEN 'names' END AS shape FROM f1),
 f AS (SELECT rec_id, id, y->>'$.name' AS name, y->'$.value' AS value FROM (SELECT rec_id, id, unnest(CASE shape WHEN 'array' THEN CAST(x AS JSON[]) WHEN 'pair' THEN [x] END) AS y FROM f2 WHERE shape IN ('array', 'pair')) WHERE json_type(y) = 'OBJECT'
  UNION ALL SELECT rec_id, id, k, x->('$."' || k || '"') FROM (SELECT rec_id, id, x, unnest(json_keys(x)) AS k FROM f2 WHERE shape = 'names'))
"""


def _many(key: str, of: str = "o") -> str:
    """An array of objects, or the one object written in its place."""
    return f"CASE json_type({of}->'$.{key}') WHEN 'ARRAY' THEN CAST({of}->'$.{key}' AS JSON[]) WHEN 'OBJECT' THEN [{of}->'$.{key}'] ELSE [] END"


_RECORDS = _RECORDS.format(layers=_many("layers", "b"), **{k: _many(k) for k in ("nodes", "annotations", "regions", "edges")})
_TARGETS = "coalesce(CASE json_type(o->'$.{0}') WHEN 'ARRAY' THEN CAST(o->'$.{0}' AS VARCHAR[]) WHEN 'VARCHAR' THEN string_split_regex(trim(o->>'$.{0}'), '\\s+') END, CAST([] AS VARCHAR[]))"

SQL: dict[str, str] = {
    "p6_found": _ROWS + " SELECT row_id, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 7 THEN 'columns' ELSE 'value' END AS reason FROM q LEFT JOIN j USING (row_id) WHERE NOT quoted OR len(f) <> 7 OR NOT j.ok",
    "p7_found": _RECORDS + """
 SELECT rec_id, 'layer' AS obj_kind, id AS child_id, doc AS parent_id FROM l
 UNION ALL SELECT rec_id, 'region', o->>'$.id', layer FROM g UNION ALL SELECT rec_id, 'node', id, parent FROM n UNION ALL SELECT rec_id, 'annotation', id, ref FROM a
 UNION ALL SELECT rec_id, 'edge', o->>'$.id', o->>'$.from' FROM e UNION ALL SELECT rec_id, 'feature', name, id FROM f""",
    "p7_layers": _RECORDS + " SELECT rec_id, id AS layer_id, doc, o->>'$.type' AS type FROM l",
    "p7_nodes": _RECORDS + f" SELECT rec_id, layer, parent, id AS node_id, array_to_string({_TARGETS.format('targets')}, ' ') AS targets FROM n",
    "p7_regions": _RECORDS + f" SELECT rec_id, layer, o->>'$.id' AS region_id, try_cast(coalesce(o->>'$.start', ({_TARGETS.format('anchors')})[1]) AS INT) AS start, try_cast(coalesce(o->>'$.end', ({_TARGETS.format('anchors')})[2]) AS INT) AS \"end\" FROM g",
    "p7_annotations": _RECORDS + " SELECT rec_id, layer, ref, id AS annotation_id, o->>'$.label' AS label FROM a",
    "p7_features": _RECORDS + " SELECT rec_id, id AS annotation_id, name, CAST(value AS VARCHAR) AS value_json FROM f",
    "p7_edges": _RECORDS + " SELECT rec_id, layer, o->>'$.id' AS edge_id, o->>'$.from' AS from_id, o->>'$.to' AS to_id FROM e",
}

