"""The exchanges of byte windows outside Spark against brute force, and that their steps do not grow with places."""

import dataclasses
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard

from tests.llm import brute
from zipledger.llm import byte_windows, suffix_array

NAMES = ["part", "bucket", "kind", "blob"]


def by(frames, name):
    every = pd.concat([pd.DataFrame(columns=NAMES), *frames])
    return {int(k): g.reset_index(drop=True) for k, g in every.groupby(name)}


def report(docs, rule, parts, buckets, split=1):
    """The rows of ``suffix_array.report``; a part's texts come to the first step in ``split`` tasks."""
    packer = zstandard.ZstdCompressor(level=1)
    table = pd.DataFrame([(i % parts, i, d or 0, d is None, packer.compress((t or "").encode()))
                          for i, (d, t) in enumerate(docs)], columns=["__part", "__seq", "__doc", "__no_id", "__z"])
    groups = {k: g.reset_index(drop=True) for k, g in table.groupby("__part")}
    none = pd.DataFrame(columns=NAMES)
    sent = []
    for part, rows in groups.items():
        for some in np.array_split(np.arange(len(rows)), split):
            if len(some):
                batch = pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int64()),
                                                    pa.array(rows["__z"][some], pa.binary())], ["__part", "__z"])
                sent += [b.to_pandas() for b in byte_windows.send_grams(rule, buckets)([batch])]
    known = [byte_windows.answer_grams(rule.hot)(g) for g in by(sent, "bucket").values()]
    contexts = [byte_windows.send_contexts(rule, buckets)(rows, by(known, "part").get(part, none)) for part, rows in groups.items()]
    answers = [byte_windows.answer_contexts(rule)(g) for g in by(contexts, "bucket").values()]
    out = pd.concat([byte_windows.finish(rule, buckets, False)(rows, by([*known, *answers], "part").get(part, none))
                     for part, rows in groups.items()]).sort_values("__seq")
    return [(d, *row[1:]) for (d, _), row in zip(docs, out.itertuples(index=False, name=None))]


def prose(rng, letters, most):
    """Random texts of a few letters with pieces of each other, some without a doc_id, some of one doc_id."""
    docs = []
    for i in range(60):
        text = "".join(chr(97 + c) for c in rng.integers(0, letters, rng.integers(0, most)))
        if docs and rng.random() < 0.7:
            other = docs[rng.integers(len(docs))][1]
            a = int(rng.integers(0, len(other) + 1))
            text = text[:len(text) // 2] + other[a:a + int(rng.integers(1, most))] + text[len(text) // 2:]
        docs.append((None if rng.random() < 0.1 else int(rng.integers(0, 40)), text))
    return docs


@pytest.mark.parametrize("length", [1, 3, 20, 21, 50, 300])
@pytest.mark.parametrize("hot", [2, 5, 2000])
def test_windows_by_brute_force(length, hot):
    rng = np.random.default_rng(length * 10 + hot)
    rule = dataclasses.replace(suffix_array.rule(length), hot=hot)
    for letters, parts, buckets, split in ((2, 3, 4, 1), (26, 7, 2, 2), (1, 2, 3, 1)):
        docs = prose(rng, letters, 4 * length)
        got = report(docs, rule, parts, buckets, split)
        assert got == brute.repeated_bytes(docs, length)


@pytest.mark.parametrize("rows", [1, 7])
def test_groups_are_worked_on_in_blocks(rows, monkeypatch):
    monkeypatch.setattr(byte_windows, "ROWS", rows)
    docs = prose(np.random.default_rng(5), 2, 200)
    assert report(docs, suffix_array.rule(50), 3, 2) == brute.repeated_bytes(docs, 50)
    assert report(brute.texts(), suffix_array.rule(50), 5, 3) == brute.repeated_bytes(brute.texts(), 50)


def test_bytes_of_many_values():
    rng = np.random.default_rng(8)
    base = [bytes(rng.integers(0, 256, 64, dtype=np.uint8)) for _ in range(40)]
    strings = [b[:k] + bytes(rng.integers(0, 256, 64 - k, dtype=np.uint8)) for b in base for k in (0, 8, 24, 40, 63, 64)] * 2
    order, common = suffix_array.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order.tolist()) == list(range(len(strings)))
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        assert common[k] == next((i for i in range(64) if a[i] != b[i]), 64)


def python_calls(run):
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event == "call"
    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return calls[0]


def test_ordering_takes_no_step_per_suffix():
    rng = np.random.default_rng(1)
    heads = [bytes(rng.integers(97, 123, 30, dtype=np.uint8)) for _ in range(500)]
    strings = [h + bytes(rng.integers(97, 123, 20, dtype=np.uint8)) for h in heads for _ in range(8)]
    assert python_calls(lambda: suffix_array.deep_shallow(strings)) < len(strings) / 4


def test_parts_are_large(spark, monkeypatch):
    """Messages are parts times buckets, so many small parts cost more than the texts do."""
    seen, staged = [], suffix_array.staged
    monkeypatch.setattr(suffix_array, "staged", lambda *a: seen.append(staged(*a)) or seen[-1])
    docs = spark.createDataFrame([(i, brute.prose(i, 20) * 3000) for i in range(12)], "doc_id long, text string")
    suffix_array.report(docs.coalesce(1))
    assert sum(len(brute.prose(i, 20)) * 3000 for i in range(12)) > 4 << 20
    assert seen[0].select("__part").distinct().count() == 1
