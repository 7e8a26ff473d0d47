"""Constituency trees: reading, rendering, transforms, heads and dependencies.

A tree is (label, children) with children either trees or, for a preterminal, one word. Trees live in
STRING columns in bracket notation; the functions here run inside Arrow-batched maps. The node table
(sent_id, node, parent, child, depth, label, begin, end, word) is what joins and aggregates work on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.words import BRACKETS

Tree = tuple  # (label, [Tree, ...]) or (label, "word")
_TOKEN = re.compile(r"[()]|[^\s()]+")
EMPTY = "-NONE-"


def read(text: str | None, root: str = "TOP") -> Tree | None:
    """A tree of its bracket notation; None for null, blank and unbalanced texts and for nodes that
    hold a word beside children or two words. An outermost bracket without a label gets the root's."""
    tokens = _TOKEN.findall(text or "")
    stack: list[list] = []
    done: Tree | None = None
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if done is not None:
            return None
        if t == "(":
            label = ""
            if i + 1 < len(tokens) and tokens[i + 1] not in "()":
                i += 1
                label = tokens[i]
            stack.append([label or root, [], None])
        elif t == ")":
            if not stack:
                return None
            label, kids, word = stack.pop()
            if word is not None and kids:
                return None
            node = (label, word) if word is not None else (label, kids)
            if stack:
                stack[-1][1].append(node)
            else:
                done = node
        elif not stack:
            return None
        else:
            if stack[-1][2] is not None:
                return None
            stack[-1][2] = BRACKETS.get(t, t)
        i += 1
    return done if not stack else None


def is_leaf(t: Tree) -> bool:
    return isinstance(t[1], str)


def fold(t: Tree, f: Callable[[Tree, list], object]):
    """f(node, results of its children), bottom up and without recursion, so trees may be of any depth."""
    todo: list[tuple[Tree, int]] = [(t, -1)]
    done: list = []
    while todo:
        node, at = todo.pop()
        if at < 0:
            todo.append((node, len(done)))
            if not is_leaf(node):
                todo += [(k, -1) for k in reversed(node[1])]
        else:
            kids = done[at:]
            del done[at:]
            done.append(f(node, kids))
    return done[0]


def render(t: Tree) -> str:
    escape = {v: k for k, v in BRACKETS.items()}
    out: list[str] = []
    todo: list = [t]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif is_leaf(x):
            out.append(f"({x[0]} {escape.get(x[1], x[1])})")
        elif not x[1]:
            out.append(f"({x[0]})")
        else:
            out.append(f"({x[0]} ")
            todo.append(")")
            for i in range(len(x[1]) - 1, -1, -1):
                todo.append(x[1][i])
                if i:
                    todo.append(" ")
    return "".join(out)


def preorder(t: Tree) -> Iterator[Tree]:
    todo = [t]
    while todo:
        x = todo.pop()
        yield x
        if not is_leaf(x):
            todo += reversed(x[1])


def postorder(t: Tree) -> Iterator[Tree]:
    todo = [(t, False)]
    while todo:
        x, seen = todo.pop()
        if seen or is_leaf(x):
            yield x
        else:
            todo.append((x, True))
            todo += [(k, False) for k in reversed(x[1])]


def leaves(t: Tree) -> list[tuple[str, str]]:
    """(tag, word) from left to right, empty elements left out."""
    return [(x[0], x[1]) for x in preorder(t) if is_leaf(x) and x[0] != EMPTY]


def relabel(t: Tree, f: Callable[[str], str]) -> Tree:
    return fold(t, lambda x, kids: (f(x[0]), x[1] if is_leaf(x) else kids))


def spans(t: Tree) -> list[tuple[str, int, int, int, int, int, str | None]]:
    """(label, begin, end, parent's place, child number, depth, word) in preorder; empty elements
    have no width."""
    out: list[list] = []
    todo: list[tuple[Tree, int, int, int]] = [(t, -1, 0, 0)]
    at = 0
    while todo:
        x, parent, child, depth = todo.pop()
        here = len(out)
        out.append([x[0], at, at, parent, child, depth, None])
        if is_leaf(x):
            at += x[0] != EMPTY
            out[here][2], out[here][6] = at, x[1]
        else:
            todo += [(k, here, i, depth + 1) for i, k in reversed(list(enumerate(x[1])))]
    for row in reversed(out):  # a node ends where the last node below it ends
        if row[3] >= 0:
            out[row[3]][2] = max(out[row[3]][2], row[2])
    return [tuple(row) for row in out]


def without_empty(t: Tree) -> Tree | None:
    """Without traces and the nodes that held nothing else."""

    def keep(x: Tree, kids: list) -> Tree | None:
        if is_leaf(x):
            return None if x[0] == EMPTY else x
        kids = [k for k in kids if k is not None]
        return (x[0], kids) if kids else None

    return fold(t, keep)


def without_repeats(t: Tree) -> Tree:
    """An only child with its parent's label takes the parent's place."""

    def merge(x: Tree, kids: list) -> Tree:
        if is_leaf(x):
            return x
        return kids[0] if len(kids) == 1 and kids[0][0] == x[0] else (x[0], kids)

    return fold(t, merge)


def base_label(label: str) -> str:
    """Without functional tags and indices; labels that begin with a dash stay."""
    return label if label.startswith("-") or not re.search("[-=#]", label) else re.split("[-=#]", label)[0] or label


def standardize(t: Tree) -> Tree | None:
    """The usual clean-up: no traces, no functional tags, no X over X."""
    u = without_empty(t)
    return without_repeats(relabel(u, base_label)) if u else None


def annotate_parents(t: Tree, order: int = 1) -> Tree:
    """Labels of inner nodes gain those of their `order` nearest ancestors."""
    rows = spans(t)
    above: list[tuple[str, ...]] = []
    for label, _, _, parent, *_ in rows:
        above.append(() if parent < 0 else (rows[parent][0], *above[parent])[:order])
    at = iter(_postorder_places(rows))

    def build(x: Tree, kids: list) -> Tree:
        i = next(at)
        return x if is_leaf(x) else ("^".join((x[0], *above[i])), kids)

    return fold(t, build)


def _postorder_places(rows: list) -> list[int]:
    """Preorder places in the order in which a bottom-up walk meets them."""
    kids: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        kids.setdefault(r[3], []).append(i)
    out, todo = [], [(0, False)]
    while todo:
        i, seen = todo.pop()
        if seen:
            out.append(i)
        else:
            todo.append((i, True))
            todo += [(k, False) for k in reversed(kids.get(i, []))]
    return out


def binarize(t: Tree, head: Callable[[Tree], int] | None = None, horizontal: int = 2) -> Tree:
    """At most two children: children are peeled off outside the head, right ones first; inner
    nodes are @label with the last `horizontal` labels already peeled."""

    def split(x: Tree, kids: list) -> Tree:
        if is_leaf(x) or len(kids) <= 2:
            return x if is_leaf(x) else (x[0], kids)
        h = head(x) if head else 0
        lo, hi, seen, peeled = 0, len(kids), (), []
        while hi - lo > 2:
            name = "@" + x[0] + "".join("|" + s for s in seen[-horizontal:]) if seen else x[0]
            right = hi - 1 > h
            one = kids[hi - 1] if right else kids[lo]
            peeled.append((name, one, right))
            seen = (*seen, ("/" if right else "\\") + base_label(one[0]))
            lo, hi = (lo, hi - 1) if right else (lo + 1, hi)
        out: Tree = ("@" + x[0] + "".join("|" + s for s in seen[-horizontal:]), kids[lo:hi])
        for name, one, right in reversed(peeled):
            out = (name, [out, one] if right else [one, out])
        return out

    return fold(t, split)


def debinarize(t: Tree) -> Tree:
    """Inner @nodes dissolve into their parents."""

    def join(x: Tree, kids: list) -> Tree:
        if is_leaf(x):
            return x
        flat: list = []
        for k in kids:
            flat += k[1] if k[0].startswith("@") and not is_leaf(k) else [k]
        return (x[0], flat)

    return fold(t, join)


def collapse_unaries(t: Tree) -> Tree:
    """Chains of only children become one node, its label the chain joined by +."""

    def join(x: Tree, kids: list) -> Tree:
        if is_leaf(x):
            return x
        if len(kids) == 1 and not is_leaf(kids[0]):
            return (f"{x[0]}+{kids[0][0]}", kids[0][1])
        return (x[0], kids)

    return fold(t, join)


def expand_unaries(t: Tree) -> Tree:
    def part(x: Tree, kids: list) -> Tree:
        if is_leaf(x):
            return x
        names = x[0].split("+")
        out = (names[-1], kids)
        for n in reversed(names[:-1]):
            out = (n, [out])
        return out

    return fold(t, part)


# Head rules per category: (search from the left?, any of the set?, labels); the last
# resort of most categories is a list of all labels, searched from the right.
ALL_LABELS = (
    "ROOT TOP ADJP ADVP CONJP FRAG S INTJ LST NAC NX PP PRN PRT QP RRC S SBAR SBARQ SINV SQ UCP VP WHADJP WHADVP WHNP WHPP X NML NP "
    "NN NNP NNPS NNS VB VBZ VBG VBD JJ JJR JJS CC VBP PRP PRP$ PRPS CD IN TO WDT WP WP$ WRB RB SYM RB UH RP RBR RBS DT"
).split()
_ANY_RIGHT = (False, False, tuple(ALL_LABELS))
_ANY_LEFT = (True, False, tuple(ALL_LABELS))
_NOUNS = [(False, True, ("NN", "NNP", "NNPS", "NNS", "NX", "POS", "JJR")), (True, False, ("NP",)), (False, False, ("CD",)), (False, True, ("JJ", "JJS", "RB", "QP"))]
HEAD_RULES: dict[str, list[tuple[bool, bool, tuple[str, ...]]]] = {
    "": [(True, False, ("S", "SINV"))],
    "ROOT": [(True, False, ("S", "SINV"))],
    "TOP": [(True, False, ("S", "SINV"))],
    "ADJP": [(True, False, ("NNS", "QP", "NN", "$", "JJ", "ADVP", "VBN", "VBG", "ADJP", "JJR", "NP", "JJS", "DT", "FW", "RBR", "RBS", "SBAR", "RB"))],
    "ADVP": [(False, False, ("RB", "RBR", "RBS", "FW", "ADVP", "TO", "CD", "JJR", "JJ", "IN", "NP", "JJS", "NN"))],
    "CONJP": [(False, False, ("CC", "RB", "IN"))],
    "FRAG": [(False, False, tuple(ALL_LABELS[:30]))],
    "S": [(True, False, ("TO", "IN", "VP", "S", "SBAR", "ADJP", "UCP", "NP"))],
    "INTJ": [_ANY_LEFT],
    "LST": [(False, False, ("LS", ":")), _ANY_RIGHT],
    "NAC": [(True, False, ("NN", "NNS", "NNP", "NNPS", "NAC", "EX", "$", "CD", "QP", "PRP", "VBG", "JJ", "JJS", "JJR", "ADJP", "FW"))],
    "NX": [_ANY_LEFT],
    "PP": [(False, False, ("IN", "TO", "VBG", "VBN", "RP", "FW"))],
    "PRN": [_ANY_LEFT],
    "PRT": [(False, False, ("RP",))],
    "QP": [(True, False, ("$", "IN", "NNS", "NN", "JJ", "RB", "DT", "CD", "NCD", "QP", "JJR", "JJS"))],
    "RRC": [(False, False, ("VP", "NP", "ADVP", "ADJP", "PP"))],
    "SBAR": [(True, False, ("WHNP", "WHPP", "WHADVP", "WHADJP", "IN", "DT", "S", "SQ", "SBAR", "FRAG"))],
    "SBARQ": [(True, False, ("SQ", "S", "SINV", "SBARQ", "FRAG"))],
    "SINV": [(True, False, ("VBZ", "VBD", "VBP", "VB", "MD", "VP", "S", "SINV", "ADJP", "NP"))],
    "SQ": [(True, False, ("VBZ", "VBD", "VBP", "VB", "MD", "VP", "SQ"))],
    "UCP": [_ANY_RIGHT],
    "VP": [(True, False, ("TO", "VBD", "VBN", "MD", "VBZ", "VB", "VBG", "VBP", "AUX", "AUXG", "VP", "ADJP", "NN", "NNS", "NP"))],
    "WHADJP": [(False, False, ("CC", "WRB", "JJ", "ADJP"))],
    "WHADVP": [(False, False, ("CC", "WRB"))],
    "WHNP": [(True, False, ("WDT", "WP", "WP$", "WHADJP", "WHPP", "WHNP"))],
    "WHPP": [(False, False, ("IN", "TO", "FW"))],
    "X": [_ANY_RIGHT],
    "NML": _NOUNS,
    "NP": _NOUNS,
}


def head_child(t: Tree) -> int:
    """Place of the head child: a child that is the binarized form of the category, else by the
    category's rules, else by the list of all labels, else the first child."""
    kids = [base_label(k[0]) for k in t[1]]
    name = base_label(t[0])
    plain = name.removeprefix("@")
    if plain not in HEAD_RULES:
        return 0
    for from_left, any_of, labels in [(True, False, ("@" + plain,)), *HEAD_RULES[plain], _ANY_RIGHT]:
        places = range(len(kids)) if from_left else range(len(kids) - 1, -1, -1)
        if any_of:
            found = next((i for i in places if kids[i] in labels), None)
        else:
            found = next((i for name in labels for i in places if kids[i] == name), None)
        if found is not None:
            return found
    return 0


def head_leaf(t: Tree) -> tuple[int, list[tuple[int, int, str]]]:
    """(head position, arcs): arcs are (dependent, head, label of the dependent's phrase)."""
    arcs: list[tuple[int, int, str]] = []
    at = iter(range(1 << 62))

    def up(x: Tree, heads: list[int]) -> int:
        if is_leaf(x):
            return next(at)
        top = heads[head_child(x)]
        arcs.extend((h, top, k[0]) for k, h in zip(x[1], heads) if h != top)
        return top

    return fold(t, up), arcs


def dependencies(t: Tree) -> list[tuple[int, int, str]]:
    """Arcs of a tree without traces; the root's head is the number of words."""
    n = len(leaves(t))
    top, arcs = head_leaf(t)
    return sorted([*arcs, (top, n, "ROOT")])


NODES = "sent_id bigint, node int, parent int, child int, depth int, label string, begin int, end int, word string"


def node_table(df: DataFrame, id_col: str = "sent_id", tree_col: str = "tree") -> DataFrame:
    """One row per node. Null, blank and unbalanced trees have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, p, c, d, label, s, e, w) for i, x in zip(b["id"], b["tree"]) if (t := read(x)) for k, (label, s, e, p, c, d, w) in enumerate(spans(t))]
            yield pd.DataFrame(rows, columns=["sent_id", "node", "parent", "child", "depth", "label", "begin", "end", "word"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(tree_col).alias("tree")).mapInPandas(run, NODES)


def map_trees(df: DataFrame, f: Callable[[Tree], Tree | None], id_col: str = "sent_id", tree_col: str = "tree") -> DataFrame:
    """(sent_id, tree): each tree transformed and rendered; trees that become nothing are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, render(u)) for i, x in zip(b["id"], b["tree"]) if (t := read(x)) and (u := f(t))]
            yield pd.DataFrame(out, columns=["sent_id", "tree"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(tree_col).alias("tree")).mapInPandas(run, "sent_id bigint, tree string")


def dependency_table(df: DataFrame, id_col: str = "sent_id", tree_col: str = "tree") -> DataFrame:
    """(sent_id, dependent, head, label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *a) for i, x in zip(b["id"], b["tree"]) if (t := read(x)) and (u := without_empty(t)) for a in dependencies(u)]
            yield pd.DataFrame(rows, columns=["sent_id", "dependent", "head", "label"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(tree_col).alias("tree")).mapInPandas(run, "sent_id bigint, dependent int, head int, label string")


def productions(nodes: DataFrame) -> DataFrame:
    """(kind, parent, children, n): lexical, unary and longer productions, from the node table."""
    kids = nodes.where("parent >= 0").select("sent_id", F.col("parent").alias("node"), F.struct("child", "label").alias("k"))
    rhs = kids.groupBy("sent_id", "node").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    inner = nodes.where("word is null").join(rhs, ["sent_id", "node"]).select("label", F.array_join(F.transform("ks", lambda x: x["label"]), " ").alias("children"), F.size("ks").alias("k"))
    kind = F.when(F.col("k") == 1, "unary").when(F.col("k") == 2, "binary").otherwise("longer")
    rules = inner.groupBy(kind.alias("kind"), F.col("label").alias("parent"), "children").agg(F.count(F.lit(1)).alias("n"))
    words = nodes.where("word is not null").groupBy(F.col("label").alias("parent"), F.col("word").alias("children")).agg(F.count(F.lit(1)).alias("n"))
    return rules.unionByName(words.select(F.lit("lexical").alias("kind"), "parent", "children", "n"))


def contiguous(nodes: DataFrame) -> DataFrame:
    """(sent_id, valid): do all children lie inside of their parents, one behind the other?"""
    from pyspark.sql import Window

    w = Window.partitionBy("sent_id", "parent").orderBy("child")
    p = nodes.select("sent_id", F.col("node").alias("parent"), F.col("begin").alias("pb"), F.col("end").alias("pe"), F.lit(1).alias("x"))
    c = nodes.where("parent >= 0").withColumn("before", F.lag("end").over(w)).join(p, ["sent_id", "parent"])
    ok = (F.col("begin") == F.coalesce("before", "pb")) & (F.col("end") <= F.col("pe"))
    return c.groupBy("sent_id").agg(F.min(ok).alias("valid"))
