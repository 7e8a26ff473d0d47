"""Tree navigation, heads, and parsing with other decoders, masks and combined grammars."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiframe.operators import navigation, parsing, spans, trees
from lexiframe.plans.common import one_sentences, tokens
from lexiframe.plans.models import _parser, _trees


def _nodes(spark, d):
    return trees.node_table(_trees(spark, d))


def tree_neighbours(spark, d):
    """Every node's parent, siblings, first child and preorder follower."""
    return navigation.neighbours(_nodes(spark, d))


def tree_at_entities(spark, d):
    """Labels of the nodes that stand over just an entity's span."""
    e = spans.entity_segments(one_sentences(spark, d)).drop("n_words")
    return navigation.at_span(_nodes(spark, d), e).groupBy("label", "node_label").agg(F.count(F.lit(1)).alias("n"))


def tree_slash_categories(spark, d):
    return trees.map_trees(_trees(spark, d), navigation.slash_categories)


def tree_node_heads(spark, d):
    return navigation.head_table(_trees(spark, d))


def head_child_counts(spark, d):
    return navigation.head_child_counts(_trees(spark, d))


def coarse_heads(spark, d):
    """Heads of phrases from their labels and tags alone, by label and place from the phrase's begin."""
    n = _nodes(spark, d)
    leaf = n.where("word is not null and end > begin").select("sent_id", F.col("begin").alias("pos"), F.col("label").alias("tag"))
    p = n.where("word is null and end > begin").select("sent_id", "node", "label", "begin", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos")).join(leaf, ["sent_id", "pos"])
    a = p.groupBy("sent_id", "node", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tags"))
    h = a.select("label", navigation.coarse_head(F.col("label"), F.col("tags")).alias("head"))
    return h.groupBy("label", "head").agg(F.count(F.lit(1)).alias("n"))


def pcfg_rule_product(spark, d):
    """Trees of all sentences by the greatest product of rule posteriors."""
    return parsing.parse(tokens(spark, d), *_parser(spark, d), "product")


def pcfg_variational(spark, d):
    return parsing.parse(tokens(spark, d), *_parser(spark, d), "variational")


def pcfg_pruned(spark, d):
    """Trees of all sentences under the spans that posteriors and the rule of long spans leave."""
    return parsing.parse(tokens(spark, d), *_parser(spark, d), "pruned")


QUERIES = {f.__name__: f for f in (
    tree_neighbours, tree_at_entities, tree_slash_categories, tree_node_heads, head_child_counts, coarse_heads, pcfg_rule_product, pcfg_variational, pcfg_pruned,
)}


def _sql():
    from lexiframe.plans.models import _TREE
    from lexiframe.plans.spans import _SEG

    tree = _TREE.split(",\n tk AS", 1)[1]
    first = "list_filter(generate_series(1, len(tags)), lambda i: list_contains([{}], tags[i]))[{}] - 1"
    heads = {"ADJP": (1, "NNS NN $ JJ VBN VBG JJR JJS"), "ADVP": (-1, "RB RBR RBS FW"), "QP": (1, "$ IN CD"), "PP": (1, "IN TO VBG VBN RP FW"), "S": (1, "TO VBD VBN MD VBZ VB VBG VBP"), "VP": (1, "TO VBD VBN MD VBZ VB VBG VBP")}
    whens = " ".join(f"WHEN label = '{k}' THEN coalesce({first.format(', '.join(repr(t) for t in v.split()), side)}, {'0' if side > 0 else 'len(tags) - 1'})" for k, (side, v) in heads.items())
    return {
        "tree_neighbours": f"""WITH {_TREE}, x AS (SELECT node.sent_id, node.node, node.word, par.parent FROM node LEFT JOIN par ON par.sent_id = node.sent_id AND par.node = node.node)
 SELECT sent_id, node, parent AS up, lag(node) OVER f AS "left", lead(node) OVER f AS "right", CASE WHEN word IS NULL AND lead(parent) OVER o = node THEN node + 1 END AS down, lead(node) OVER o AS next
 FROM x WINDOW f AS (PARTITION BY sent_id, parent ORDER BY node), o AS (PARTITION BY sent_id ORDER BY node)""",
        "tree_at_entities": f"WITH {_SEG},\n tk AS{tree} SELECT seg.label, node.label AS node_label, count(*) AS n FROM seg JOIN node ON node.sent_id = seg.sent_id AND node.b = seg.b AND node.e = seg.e GROUP BY 1, 2",
        "coarse_heads": f"""WITH {_TREE}, a AS (SELECT p.sent_id, p.node, p.label, list(l.label ORDER BY l.b) AS tags FROM node p JOIN node l ON l.sent_id = p.sent_id AND l.word IS NOT NULL AND l.b >= p.b AND l.b < p.e WHERE p.word IS NULL GROUP BY 1, 2, 3),
 s AS (SELECT *, coalesce(list_filter(generate_series(1, len(tags)), lambda i: list_contains([',', 'WDT', 'TO', 'IN', '-LRB-', ':', 'CC', '('], tags[i]))[1], 0) AS stop FROM a),
 h AS (SELECT label, CASE WHEN label = 'PRN' THEN CASE WHEN len(tags) > 1 THEN 1 ELSE 0 END
   WHEN label = 'NP' THEN coalesce(list_filter(generate_series(1, CASE WHEN stop > 0 THEN stop ELSE len(tags) END), lambda i: list_contains(['NN', 'NNP', 'NNPS', 'NNS', 'NX', 'POS', 'JJR', '$', 'PRN'], tags[i]))[-1] - 1, CASE WHEN stop > 0 THEN greatest(0, stop - 2) ELSE len(tags) - 1 END)
   {whens} ELSE 0 END AS head FROM s) SELECT label, CAST(head AS INT) AS head, count(*) AS n FROM h GROUP BY 1, 2""",
    }


SQL = _sql()
