"""Trees, sequence models, parsing, vectors and other corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiframe.operators import evaluation, parsing, sequence, trees
from lexiframe.plans.common import ONE, TAGGED, delivered, held_out, one_sentences, tagged, tagged_arrays, tokens, training
from lexiframe.session import cut, spread


def _trees(spark, d):
    return one_sentences(spark, d).select("sent_id", F.col("annotations.tree").alias("tree"))


def tree_nodes(spark, d):
    return trees.node_table(_trees(spark, d)).select("sent_id", "node", "depth", "label", "begin", "end", "word")


def tree_parents(spark, d):
    n = trees.node_table(_trees(spark, d))
    p = n.select("sent_id", F.col("node").alias("parent"), F.col("label").alias("parent_label"))
    return n.join(p, ["sent_id", "parent"]).groupBy("parent_label", "label").agg(F.count(F.lit(1)).alias("n"))


def tree_leaves(spark, d):
    n = trees.node_table(_trees(spark, d)).where("word is not null")
    return n.select("sent_id", F.col("begin").alias("pos"), F.col("label").alias("tag"), "word")


def tree_productions(spark, d):
    return trees.productions(trees.node_table(_trees(spark, d)))


def tree_valid(spark, d):
    return trees.contiguous(trees.node_table(_trees(spark, d)))


def tree_render(spark, d):
    return trees.map_trees(_trees(spark, d), lambda t: t)


def tree_standard(spark, d):
    return trees.map_trees(_trees(spark, d), trees.standardize)


def tree_parent_annotated(spark, d):
    return trees.map_trees(_trees(spark, d), trees.annotate_parents)


def tree_binarized(spark, d):
    return trees.map_trees(_trees(spark, d), lambda t: trees.binarize(trees.collapse_unaries(t), trees.head_child))


def tree_round_trip(spark, d):
    """Binarized and back again: the same as rendered."""
    return trees.map_trees(_trees(spark, d), lambda t: trees.expand_unaries(trees.debinarize(trees.binarize(trees.collapse_unaries(t), trees.head_child))))


def tree_dependencies(spark, d):
    return trees.dependency_table(_trees(spark, d))


def tree_tagged_sequence(spark, d):
    """Tags of trees against the tag table: tokens and agreements."""
    leaves = tree_leaves(spark, d).select("sent_id", "pos", F.col("tag").alias("gold"))
    t = tagged(spark, d).select("sent_id", "pos", F.col("tag").alias("pred"))
    return evaluation.tagging(leaves.join(t, ["sent_id", "pos"]))


def _confused(nodes):
    """The nodes as a guesser would have them who calls prepositional phrases that begin at an even place
    noun phrases, drops verb phrases of one word and reads past tenses as participles."""
    even, short = F.col("begin") % 2 == 0, F.col("end") == F.col("begin") + 1
    label = F.when((F.col("label") == "PP") & even, "NP").when((F.col("label") == "VBD") & even, "VBN").otherwise(F.col("label"))
    return nodes.where(~((F.col("label") == "VP") & short & F.col("word").isNull())).withColumn("label", label)


def bracket_prf(spark, d):
    """Labelled brackets of the trees against those of a guesser with known faults."""
    n = trees.node_table(_trees(spark, d))
    keep = lambda df: df.where("word is null and label not in ('TOP', '')").select("sent_id", "label", "begin", "end")
    return evaluation.precision_recall(keep(n), keep(_confused(n)), ["sent_id", "label", "begin", "end"], ["label"])


def bracket_scores(spark, d):
    """The same guesser by all scores of a parse evaluation: brackets, exact matches and tags."""
    n = trees.node_table(_trees(spark, d))
    return evaluation.brackets(n, _confused(n))


def _hmm(spark, d):
    """Tables from the tagged tokens of the training sentences, which are joined once for all three."""
    return sequence.hmm_tables_of(cut(training(tagged_arrays(spark, d), spark, d)))


def _word_rows(spark, d):
    """All sentences as rows for decode_rows(), shuffled once."""
    words = F.transform("words", lambda w: F.coalesce(F.trim(w), F.lit("")))
    s = spread(delivered(spark, d).select(sequence.block_of(spark).alias("block"), "sent_id", words.alias("words")), "block").dropDuplicates(["block", "sent_id"])
    s = s.where(F.size("words") > 0)
    return s.select("block", "sent_id", F.sequence(F.lit(0), F.size("words") - 1).alias("pos"), "words")


def hmm_emissions(spark, d):
    return sequence.hmm_tables(tagged(spark, d))[1].select("word", "tag", F.round("score", 6).alias("score"))


def hmm_viterbi(spark, d):
    """Tags of every token of all sentences."""
    return sequence.decode_rows(_word_rows(spark, d), _hmm(spark, d))


def crf_posterior(spark, d):
    return sequence.decode_rows(_word_rows(spark, d), _hmm(spark, d), "posterior")


def hmm_accuracy(spark, d):
    odd = held_out(tagged(spark, d), spark, d)
    p = sequence.decode(odd.select("sent_id", "pos", "word"), _hmm(spark, d)).select("sent_id", "pos", F.col("tag").alias("pred"))
    return evaluation.tagging(odd.select("sent_id", "pos", F.col("tag").alias("gold")).join(p, ["sent_id", "pos"]))


def pcfg_rules(spark, d):
    r = parsing.extract(_trees(spark, d))
    return r.select("kind", "parent", "children", "n", F.round("logp", 6).alias("logp"))


def _parser(spark, d):
    """Grammar and word scores from the training sentences."""
    _, em, un = _hmm(spark, d)
    em, un = cut(em), {r["tag"]: r["score"] for r in un.collect()}  # by tag
    # unknown words get the open classes: the tags of most different words
    opened = {r["tag"] for r in em.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(6).collect()}
    unknown = {y: v for y, v in un.items() if y in opened}
    g = parsing.grammar(parsing.extract(training(_trees(spark, d), spark, d)), list(un))
    return g, em, unknown


def pcfg_parse(spark, d):
    """Trees of all sentences, also of those without a gold tree."""
    return parsing.parse(tokens(spark, d), *_parser(spark, d))


def pcfg_max_constituent(spark, d):
    return parsing.parse(tokens(spark, d), *_parser(spark, d), "constituent")


def pcfg_kbest(spark, d):
    return parsing.parse(tokens(spark, d), *_parser(spark, d), "kbest")


def parse_eval(spark, d):
    """Labelled precision, recall and F1 of the parser on the held-out sentences."""
    odd = held_out(_trees(spark, d), spark, d).where("tree is not null")
    toks = tokens(spark, d).join(odd.select("sent_id"), "sent_id", "left_semi")
    guess = trees.node_table(parsing.parse(toks, *_parser(spark, d))).where("word is null")
    gold = trees.node_table(odd).where("word is null")
    return evaluation.precision_recall(gold, guess, ["sent_id", "label", "begin", "end"])


QUERIES = {f.__name__: f for f in (
    tree_nodes, tree_parents, tree_leaves, tree_productions, tree_valid, tree_render, tree_standard, tree_parent_annotated, tree_binarized,
    tree_round_trip, tree_dependencies, tree_tagged_sequence, bracket_prf, bracket_scores, hmm_emissions, hmm_viterbi, crf_posterior, hmm_accuracy,
    pcfg_rules, pcfg_parse, pcfg_max_constituent, pcfg_kbest, parse_eval,
)}

_TREE = ONE + r""",
 tk AS (SELECT sent_id, i, t FROM (SELECT sent_id, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM (SELECT sent_id, regexp_extract_all(annotations.tree, '[()]|[^\s()]+') AS a FROM one WHERE annotations.tree IS NOT NULL))),
 st AS (SELECT sent_id, i, t, lag(t) OVER w AS before, lead(t) OVER w AS label, lead(t, 2) OVER w AS word, sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY sent_id ORDER BY i) AS dep FROM tk WINDOW w AS (PARTITION BY sent_id ORDER BY i)),
 lf AS (SELECT *, sum(CASE WHEN t NOT IN ('(', ')') AND before <> '(' THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id ORDER BY i) AS seen FROM st),
 op AS (SELECT *, row_number() OVER (PARTITION BY sent_id, dep ORDER BY i) AS k, row_number() OVER (PARTITION BY sent_id ORDER BY i) - 1 AS node FROM lf WHERE t = '('),
 cl AS (SELECT sent_id, dep + 1 AS dep, seen, i, row_number() OVER (PARTITION BY sent_id, dep ORDER BY i) AS k FROM lf WHERE t = ')'),
 node AS (SELECT op.sent_id, CAST(node AS INT) AS node, CAST(op.dep - 1 AS INT) AS depth, label, CAST(op.seen AS INT) AS b, CAST(cl.seen AS INT) AS e, op.i AS oi, cl.i AS ci,
   CASE WHEN word NOT IN ('(', ')') THEN CASE word WHEN '-LRB-' THEN '(' WHEN '-RRB-' THEN ')' WHEN '-LSB-' THEN '[' WHEN '-RSB-' THEN ']' WHEN '-LCB-' THEN '{' WHEN '-RCB-' THEN '}' ELSE word END END AS word
   FROM op JOIN cl USING (sent_id, dep, k)),
 par AS (SELECT c.*, p.node AS parent, p.label AS parent_label FROM node c JOIN node p ON c.sent_id = p.sent_id AND p.depth = c.depth - 1 AND p.oi < c.oi AND p.ci > c.ci)"""
_GUESS = """guess AS (SELECT sent_id, b, e, word, CASE WHEN label = 'PP' AND b % 2 = 0 THEN 'NP' WHEN label = 'VBD' AND b % 2 = 0 THEN 'VBN' ELSE label END AS label
   FROM node WHERE NOT (label = 'VP' AND e = b + 1 AND word IS NULL))"""
_HMM = f"""WITH {TAGGED}, c AS (SELECT word, tag, count(*) AS ctw FROM tagged GROUP BY 1, 2), cw AS (SELECT word, sum(ctw) AS cw FROM c GROUP BY 1), ct AS (SELECT tag, sum(ctw) AS ct FROM c GROUP BY 1),
 z AS (SELECT count(DISTINCT word) AS v, sum(ctw) AS total FROM c),
 a AS (SELECT word, tag, ct, total, CASE WHEN cw < 10 THEN cw + 1 ELSE cw END AS cw, CASE WHEN cw < 10 THEN ctw + ct / v ELSE ctw END AS ctw FROM c JOIN cw USING (word) JOIN ct USING (tag), z)"""

SQL = {
    "tree_nodes": f'WITH {_TREE} SELECT sent_id, node, depth, label, b AS "begin", e AS "end", word FROM node',
    "tree_parents": f"WITH {_TREE} SELECT parent_label, label, count(*) AS n FROM par GROUP BY 1, 2",
    "tree_leaves": f"WITH {_TREE} SELECT sent_id, b AS pos, label AS tag, word FROM node WHERE word IS NOT NULL",
    "tree_productions": f"""WITH {_TREE}, r AS (SELECT parent_label AS parent, string_agg(label, ' ' ORDER BY oi) AS children, count(*) AS k FROM par GROUP BY sent_id, par.parent, parent_label)
 SELECT CASE k WHEN 1 THEN 'unary' WHEN 2 THEN 'binary' ELSE 'longer' END AS kind, parent, children, count(*) AS n FROM r GROUP BY 1, 2, 3
 UNION ALL SELECT 'lexical', label, word, count(*) FROM node WHERE word IS NOT NULL GROUP BY 2, 3""",
    "tree_valid": f"WITH {_TREE} SELECT sent_id, true AS valid FROM par GROUP BY 1",
    "tree_render": ONE.join(["WITH", r" SELECT sent_id, regexp_replace(regexp_replace(annotations.tree, '\s+\)', ')', 'g'), '\s+', ' ', 'g') AS tree FROM one WHERE annotations.tree LIKE '(%'"]),
    "tree_round_trip": ONE.join(["WITH", r" SELECT sent_id, regexp_replace(regexp_replace(annotations.tree, '\s+\)', ')', 'g'), '\s+', ' ', 'g') AS tree FROM one WHERE annotations.tree LIKE '(%'"]),
    "tree_tagged_sequence": f"""WITH {_TREE}, tg AS (SELECT sent_id, tok_idx AS pos, min(upper(trim(tag))) AS tag FROM pos_tags WHERE sent_id IS NOT NULL AND tok_idx IS NOT NULL AND trim(tag) <> '' GROUP BY 1, 2),
 w AS (SELECT sent_id, len(words) AS n FROM one), p AS (SELECT node.sent_id, node.label = tg.tag AS r FROM node JOIN tg ON node.sent_id = tg.sent_id AND node.b = tg.pos JOIN w ON w.sent_id = node.sent_id AND node.b < w.n WHERE word IS NOT NULL),
 s AS (SELECT sent_id, count(*) AS n, count(*) FILTER (r) AS r FROM p GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(r) AS BIGINT) AS n_right, count(*) AS n_sentences, count(*) FILTER (n = r) AS n_exact FROM s""",
    "bracket_prf": f"""WITH {_TREE}, {_GUESS}, g AS (SELECT DISTINCT sent_id, label, b, e FROM node WHERE word IS NULL AND label NOT IN ('TOP', '')), p AS (SELECT DISTINCT sent_id, label, b, e FROM guess WHERE word IS NULL AND label NOT IN ('TOP', '')),
 u AS (SELECT coalesce(g.label, p.label) AS label, g.sent_id IS NOT NULL AS ig, p.sent_id IS NOT NULL AS ip FROM g FULL JOIN p ON g.sent_id = p.sent_id AND g.label = p.label AND g.b = p.b AND g.e = p.e),
 c AS (SELECT label, count(*) FILTER (ig) AS n_gold, count(*) FILTER (ip) AS n_guess, count(*) FILTER (ig AND ip) AS n_right FROM u GROUP BY 1)
 SELECT *, round(CASE WHEN n_guess = 0 THEN 1.0 ELSE n_right / n_guess END, 6) AS precision, round(CASE WHEN n_gold = 0 THEN 1.0 ELSE n_right / n_gold END, 6) AS recall, round(2 * n_right / (n_gold + n_guess), 6) AS f1 FROM c""",
    "bracket_scores": f"""WITH {_TREE}, {_GUESS}, i AS (SELECT unnest(['', 'TOP', '''''', '``', '.', ':', ',']) AS x),
 g AS (SELECT DISTINCT sent_id, label, b, e FROM node WHERE word IS NULL AND label NOT IN (SELECT x FROM i)), p AS (SELECT DISTINCT sent_id, label, b, e FROM guess WHERE word IS NULL AND label NOT IN (SELECT x FROM i)),
 r AS (SELECT g.* FROM g JOIN p USING (sent_id, label, b, e)), ids AS (SELECT DISTINCT sent_id FROM node),
 s AS (SELECT sent_id, (SELECT count(*) FROM g WHERE g.sent_id = ids.sent_id) AS ng, (SELECT count(*) FROM p WHERE p.sent_id = ids.sent_id) AS np, (SELECT count(*) FROM r WHERE r.sent_id = ids.sent_id) AS nr FROM ids),
 t AS (SELECT count(*) AS n_tags, count(*) FILTER (NOT (label = 'VBD' AND b % 2 = 0)) AS n_tags_right FROM node WHERE word IS NOT NULL AND e > b),
 a AS (SELECT CAST(sum(ng) AS BIGINT) AS n_gold, CAST(sum(np) AS BIGINT) AS n_guess, CAST(sum(nr) AS BIGINT) AS n_right, count(*) AS n_sentences, count(*) FILTER (ng = nr AND np = nr) AS n_exact FROM s)
 SELECT a.*, round(n_right / n_guess, 6) AS precision, round(n_right / n_gold, 6) AS recall, round(2 * n_right / (n_gold + n_guess), 6) AS f1, t.* FROM a, t""",
    "hmm_emissions": f"{_HMM} SELECT word, tag, round(ln(cw / (total + 1)) + ln(ctw / cw) - ln(ct / total), 6) AS score FROM a",
}
