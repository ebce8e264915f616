"""Substring dedup: words of 35-word windows that occur more than once in the corpus.

Works on the exchanges of ``repeats``, whose k-grams are the suffixes' first prefixes and
whose hot ones are lengthened. Within a bucket, prefixes grow word by word until each
group of suffixes fits in memory (``GROUP``), and a suffix tree is built for each group:
edges hold runs of words, a new suffix walks down and splits an edge where it departs.
Leaves are read from left to right; what two neighbours have in common is the depth of the
internal node above both, and nodes as deep as a window are the maximal repeats.

Defined results: a null or empty text, or one without words, loses none. Repeated rows are
places of their own, so both lose what they share. Null ids pass through. No documents make
no rows. Extra columns pass through ``remove`` and are ignored otherwise.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zipledger.llm.common import aside, id_text
from zipledger.llm.repeats import Rule, find, staged

#: Suffixes in one tree, at most, unless they agree in all words.
GROUP = 4096


def prefix_groups(suffixes: list[tuple], limit: int = GROUP) -> list[tuple[int, list[int]]]:
    """(prefix length, rows): groups by prefixes just long enough for ``limit`` rows each."""
    todo, out = [(0, list(range(len(suffixes))))], []
    while todo:
        depth, rows = todo.pop()
        if len(rows) <= limit or all(len(suffixes[r]) <= depth for r in rows):
            out.append((depth, rows))
            continue
        longer = defaultdict(list)
        for r in rows:
            longer[suffixes[r][depth] if len(suffixes[r]) > depth else -1].append(r)
        todo += [(depth + 1, g) for g in longer.values()]
    return out


class Node:
    """A node of a suffix tree: its depth in words, children by first word, rows that end here."""

    __slots__ = ("children", "depth", "rows", "source")

    def __init__(self, depth: int, source: tuple):
        self.depth, self.source, self.children, self.rows = depth, source, {}, []


def suffix_tree(suffixes: list[tuple], rows: list[int], depth: int) -> Node:
    """The tree of some suffixes that agree in their first ``depth`` words."""
    root = Node(depth, suffixes[rows[0]])
    for r in rows:
        words, node = suffixes[r], root
        while True:
            if len(words) <= node.depth:
                node.rows.append(r)
                break
            child = node.children.get(words[node.depth])
            if child is None:
                leaf = node.children[words[node.depth]] = Node(len(words), words)
                leaf.rows.append(r)
                break
            end, other = min(len(words), child.depth), child.source
            if words[node.depth:end] == other[node.depth:end]:
                at = end
            else:
                at = next(i for i in range(node.depth, end) if words[i] != other[i])
            if at < child.depth:  # split the edge
                middle = Node(at, other)
                middle.children[other[at]] = child
                node.children[words[node.depth]] = middle
                child = middle
            node = child
    return root


def leaves(root: Node) -> tuple[list[int], list[int]]:
    """Rows from left to right, and the depth of the node above each and its left neighbour."""
    order: list[int] = []
    common: list[int] = []
    todo: list[tuple[Node, int]] = [(root, 0)]
    while todo:
        node, above = todo.pop()
        for i, r in enumerate(node.rows):
            order.append(r)
            common.append(node.depth if i else above)
        first = not node.rows
        children = list(node.children.values())
        todo += [(c, node.depth) for c in children[:0:-1]]
        if children:
            todo.append((children[0], above if first else node.depth))
    return order, common


def tree_order(suffixes: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in tree order, and what each has in common with the one before it."""
    names: dict[bytes, int] = {}
    numbered = [tuple(names.setdefault(w, len(names)) for w in s) for s in suffixes]
    order: list[int] = []
    common: list[int] = []
    before = None
    # groups of one prefix stand next to each other, longer prefixes within shorter ones
    for depth, rows in sorted(prefix_groups(numbered), key=lambda g: numbered[g[1][0]][:g[0]]):
        mine, shared = leaves(suffix_tree(numbered, rows, depth))
        if before is not None:
            a, b = numbered[before], numbered[mine[0]]
            shared[0] = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        order += mine
        common += shared
        before = mine[-1]
    return np.array(order), np.array(common)


def rule(window: int = 35) -> Rule:
    return Rule(words=True, n=window, k=max(1, window // 3), order=tree_order)


def report(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    parts = staged(id_text(docs))
    found = find(parts, rule(window))
    return found.join(parts.select("__seq", "doc_id"), "__seq").select(
        "doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def remove(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with the remaining words, joined by a space, as text; all columns and rows."""
    plain = aside(docs)
    parts = staged(plain)
    kept = find(parts, rule(window), with_text=True).select("__seq", F.col("kept").alias("__kept"))
    rest = parts.drop("__z", "__part", "__doc", "__no_id").join(kept, "__seq")
    return rest.select(*[F.col("__kept" if c == "text" else c).cast(t) for c, t in plain.dtypes]).toDF(*docs.columns)
