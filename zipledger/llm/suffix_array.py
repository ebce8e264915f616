"""Suffix-array dedup: bytes that repeat an earlier document's 50-byte strings.

Works on the exchanges of ``repeats``; this module orders the suffixes of a bucket by
deep-shallow sorting. Suffixes are ordered by multikey quicksort on characters of eight
bytes down to a shallow depth. Those still tied have long common prefixes, on which
comparing byte by byte would go on and on; each such group is put into a blind trie,
which keeps only the branching places: a search looks at one byte per branch, compares
once with the leaf it reaches, and the common prefix shows where to branch.

Defined results: a null or empty text has no bytes and loses none. A row with a null doc_id
neither loses bytes nor makes others lose any. Rows that repeat a doc_id do not count as
earlier documents of each other. No documents make no rows. Extra columns pass through
``remove`` and are ignored otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zipledger.llm.byte_windows import BYTES
from zipledger.llm.common import aside, id_text
from zipledger.llm.repeats import Rule, find, staged

#: Text bytes in a part, and about as many behind a bucket. Messages are as many as parts times buckets.
PART_BYTES = 10 << 20
#: Eight-byte characters that quicksort looks at.
SHALLOW = 3


def _ties(names: np.ndarray) -> np.ndarray:
    """Which of some ordered names have an equal one next to them."""
    same = np.concatenate([[False], names[1:] == names[:-1], [False]])
    return (same[1:] | same[:-1])[:len(names)]


def multikey_quicksort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, group of each place): rows in a group tie in all characters (columns) of ``keys``.

    All groups that tie so far are sorted by their next character together."""
    order, group = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    for depth in range(keys.shape[1]):
        at = np.flatnonzero(_ties(group))
        if not len(at):
            break
        char = keys[order[at], depth]
        by = np.argsort(char, kind="stable")
        if depth:
            by = by[np.argsort(group[at][by], kind="stable")]
        order[at], char = order[at][by], char[by]
        new = np.zeros(len(keys), np.int64)
        new[at[1:]] = char[1:] != char[:-1]
        new[1:] |= group[1:] != group[:-1]
        group = np.cumsum(new)
    return order, group


def blind_tries(matrix: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``order`` with the rows of each group in the order of their bytes.

    A blind trie of each group, from the root down and a level of all tries at a time: a node
    is a group, its branching place the first byte in which one of its rows is not as the first
    row is, and its children the groups by that byte. Nodes whose rows are equal are leaves."""
    order, at = order.copy(), np.flatnonzero(_ties(group))
    names = group[at]
    while len(at):
        rows = order[at]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        differ = matrix[rows] != matrix[rows[first]][node]
        depth = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
        branch = np.minimum.reduceat(depth, first)[node]
        inner = branch < matrix.shape[1]
        at, rows, node, branch = at[inner], rows[inner], node[inner], branch[inner]
        names = node * 256 + matrix[rows, branch]
        by = np.argsort(names, kind="stable")
        order[at], names = rows[by], names[by]
        left = _ties(names)
        at, names = at[left], names[left]
    return order


def ordered(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by their bytes, and what each has in common with the one before it."""
    if not len(matrix):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size, width = matrix.shape
    wide = np.zeros((size, max(8 * SHALLOW, width)), np.uint8)
    wide[:, :width] = matrix
    keys = np.ascontiguousarray(wide[:, :8 * SHALLOW]).view(">u8").astype(np.uint64)
    ranked = blind_tries(wide, *multikey_quicksort(keys))
    sorted_rows = matrix[ranked]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return ranked, np.concatenate([[0], common])


def deep_shallow(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes, and what each has in common with the one before it."""
    width = max(map(len, suffixes), default=0)
    rows = b"".join([s.ljust(width, b"\0") for s in suffixes])
    return ordered(np.frombuffer(rows, np.uint8).reshape(len(suffixes), width))


def rule(length: int = 50) -> Rule:
    return Rule(words=False, n=length, k=min(20, length), order=ordered, steps=BYTES)


def report(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    parts = staged(id_text(docs), PART_BYTES)
    found = find(parts, rule(length))
    ids = parts.select("__seq", "doc_id")
    return found.join(ids, "__seq").select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans",
                                           "kept_sha256")


def remove(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with the remaining bytes as text; all columns and rows.

    A removed byte may cut a character; its other bytes go too, so that texts stay UTF-8.
    """
    plain = aside(docs)
    parts = staged(plain, PART_BYTES)
    kept = find(parts, rule(length), with_text=True).select("__seq", F.col("kept").alias("__kept"))
    rest = parts.drop("__z", "__part", "__doc", "__no_id").join(kept, "__seq")
    return rest.select(*[F.col("__kept" if c == "text" else c).cast(t) for c, t in plain.dtypes]).toDF(*docs.columns)
