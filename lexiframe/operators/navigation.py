"""Moving about in trees: neighbours in the node table, slash categories, heads of nodes, coarse heads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.operators import trees
from lexiframe.operators.trees import EMPTY, Tree

_INDEX = re.compile(r"[-=]([0-9]+)$")


def neighbours(nodes: DataFrame) -> DataFrame:
    """(sent_id, node, up, left, right, down, next): the places of each node's parent, siblings, first
    child, and of the node behind it in preorder; null where there is none."""
    family, order = Window.partitionBy("sent_id", "parent").orderBy("child"), Window.partitionBy("sent_id").orderBy("node")
    inner = F.col("word").isNull()
    return nodes.select(
        "sent_id", "node", F.when(F.col("parent") >= 0, F.col("parent")).alias("up"), F.lag("node").over(family).alias("left"), F.lead("node").over(family).alias("right"),
        F.when(inner & (F.lead("parent").over(order) == F.col("node")), F.col("node") + 1).alias("down"), F.lead("node").over(order).alias("next"),
    )


def at_span(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (sent_id, begin, end, ...) with the label and place of every node over just that span."""
    return spans.join(nodes.select("sent_id", "begin", "end", "node", F.col("label").alias("node_label")), ["sent_id", "begin", "end"])


def slash_categories(t: Tree) -> Tree | None:
    """Without traces; the nodes between a trace and the ancestor whose child it is bound to gain the
    gap's category behind a slash. A trace bound to nothing that commands it leaves no gap."""
    index = lambda label: int(m[1]) if (m := _INDEX.search(label)) else -1
    empty = lambda x: all(k[0] == EMPTY for k in trees.preorder(x) if trees.is_leaf(k))
    hollow = {id(x): empty(x) for x in trees.preorder(t)}

    # from the top down: what each node is commanded by
    bound: dict[int, frozenset[int]] = {id(t): frozenset()}
    for x in trees.preorder(t):
        if not trees.is_leaf(x):
            here = bound[id(x)] | {i for k in x[1] if not hollow[id(k)] and (i := index(k[0])) >= 0}
            for k in x[1]:
                bound[id(k)] = here

    def up(x: Tree, kids: list) -> tuple[Tree | None, list[tuple[str, int]]]:
        if trees.is_leaf(x):
            return (None, []) if x[0] == EMPTY else (x, [])
        if hollow[id(x)]:
            i = next((j for k in trees.preorder(x) if trees.is_leaf(k) and (j := index(k[1])) >= 0), index(x[0]))
            return None, [(trees.base_label(x[0]), i)] if i in bound[id(x)] else []
        own = {i for k in x[1] if not hollow[id(k)] and (i := index(k[0])) >= 0}
        gaps = [g for g in dict.fromkeys(g for _, gs in kids for g in gs) if g[1] not in own]
        name = trees.base_label(x[0]) + "".join("/" + g[0] for g in gaps)
        return (name, [k for k, _ in kids if k is not None]), gaps

    return trees.fold(t, up)[0]


def node_heads(t: Tree) -> list[tuple[int, str, str]]:
    """(head place, head tag, head word) of each node in preorder; traces must be gone."""
    rows = trees.spans(t)
    words = {r[1]: (r[0], r[6]) for r in rows if r[6] is not None}
    kids: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        kids.setdefault(r[3], []).append(i)
    head = [0] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        k = kids.get(i)
        head[i] = rows[i][1] if not k else head[k[trees.head_child((rows[i][0], [(rows[j][0], []) for j in k]))]]
    return [(h, *words[h]) for h in head]


def head_table(df: DataFrame, id_col: str = "sent_id", tree_col: str = "tree") -> DataFrame:
    """(sent_id, node, head, head_tag, head_word) of all nodes of trees without traces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *h) for i, x in zip(b["id"], b["tree"]) if (t := trees.read(x)) and (u := trees.without_empty(t)) for k, h in enumerate(node_heads(u))]
            yield pd.DataFrame(rows, columns=["sent_id", "node", "head", "head_tag", "head_word"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(tree_col).alias("tree")).mapInPandas(run, "sent_id bigint, node int, head int, head_tag string, head_word string")


def head_child_counts(df: DataFrame, id_col: str = "sent_id", tree_col: str = "tree") -> DataFrame:
    """(label, arity, child, n): how often which child is the head, by label and number of children."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(x[0], len(x[1]), trees.head_child(x)) for s in b["tree"] if (t := trees.read(s)) and (u := trees.without_empty(t)) for x in trees.preorder(u) if not trees.is_leaf(x)]
            yield pd.DataFrame(rows, columns=["label", "arity", "child"])

    c = df.select(F.col(tree_col).alias("tree")).mapInPandas(run, "label string, arity int, child int")
    return c.groupBy("label", "arity", "child").agg(F.count(F.lit(1)).alias("n"))


# Tags that head a phrase, searched from the left or right, by category.
COARSE_HEADS = {
    "ADJP": (True, "NNS NN $ JJ VBN VBG JJR JJS"), "ADVP": (False, "RB RBR RBS FW"), "QP": (True, "$ IN CD"), "PP": (True, "IN TO VBG VBN RP FW"),
    "S": (True, "TO VBD VBN MD VBZ VB VBG VBP"), "VP": (True, "TO VBD VBN MD VBZ VB VBG VBP"),
}
# Tags that can head a noun phrase, and tags behind which its head doesn't lie.
NOUN_HEADS, NOUN_STOPS = "NN NNP NNPS NNS NX POS JJR $ PRN".split(), ", WDT TO IN -LRB- : CC (".split()


def coarse_head(label: Column, tags: Column) -> Column:
    """Place of a phrase's head among its tags (ARRAY<STRING>), from its label and nothing else.

    A noun phrase's head is the last fitting tag before the first stop, else what stands before the
    stop; of other categories the first fitting tag from the searched side, else the first or last tag;
    a parenthesis is headed by its second tag, unknown categories by their first."""
    n = F.size(tags)
    out = F.when(label == "PRN", F.when(n > 1, 1).otherwise(0))
    stop = F.array_position(F.transform(tags, lambda t: t.isin(*NOUN_STOPS)), True)  # from 1; 0 when none
    before = F.when(stop > 0, F.slice(tags, F.lit(1), stop.cast("int"))).otherwise(tags)
    fits = F.filter(F.transform(before, lambda t, i: F.when(t.isin(*NOUN_HEADS), i)), lambda i: i.isNotNull())
    plain = F.when(stop > 0, F.greatest(F.lit(0), stop - 2)).otherwise(n - 1)
    out = out.when(label == "NP", F.coalesce(F.try_element_at(fits, F.lit(-1)), plain))
    for name, (left, good) in COARSE_HEADS.items():
        places = F.filter(F.transform(tags, lambda t, i: F.when(t.isin(*good.split()), i)), lambda i: i.isNotNull())  # noqa: B023
        out = out.when(label == name, F.coalesce(F.try_element_at(places, F.lit(1 if left else -1)), F.lit(0) if left else n - 1))
    return out.otherwise(0).cast("int")
