"""Output-name allocator vs the sequential replay of the collision rule."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import os

from zipledger.operators.alloc import _scan_children, allocate


def replay(bases, existing=()):
    """Brute force: extract one entry after the other, probing name, name_1, ..."""
    taken, out = set(existing), []
    for b in bases:
        stem, ext = os.path.splitext(b)
        name, i = b, 1
        while name in taken:
            name, i = f"{stem}_{i}{ext}", i + 1
        taken.add(name)
        out.append(name)
    return out

NAMES = ["a.mp4", "a_1.mp4", "a_2.mp4", "a_1_1.mp4", "a_1_2.mp4", "a", "a_1", ".a", ".a_1", "a.",
         "a_1.", "b.tar.gz", "b.tar_1.gz", "b.tar_1_1.gz", "._1.mp4", "..mp4", "a_01.mp4", "a_0.mp4"]


def run(spark, bases, existing=(), **options):
    plan = spark.createDataFrame([(i, b) for i, b in enumerate(bases)], "plan_pos long, base string")
    ex = spark.createDataFrame([(e,) for e in existing], "name string")
    got = {r.plan_pos: r.out_name for r in allocate(plan, ex, **options).collect()}
    return [got[i] for i in range(len(bases))]


def test_f13_collisions(spark):
    bases = ["a.mp4", "a.mp4", "a.mp4", "a_1.mp4", "a_1.mp4", "a_1_1.mp4"]
    assert run(spark, bases, ["a_2.mp4"]) == replay(bases, ["a_2.mp4"])


def test_many_copies_of_one_name(spark):
    bases = ["metadata.json"] * 300 + ["metadata_5.json", "metadata_400.json"] + ["metadata.json"] * 200
    assert run(spark, bases, ["metadata_3.json"]) == replay(bases, ["metadata_3.json"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 40), min_size=30, max_size=120), st.lists(st.integers(1, 60), max_size=12),
       st.sampled_from([1, 3, 7]))
def test_children_in_narrow_ranges(spark, ks, existing, width):
    # 0 is the name itself, k its k-th child: counts pass from range to range
    name = lambda k: f"m_{k}.json" if k else "m.json"
    bases, there = [name(max(k - 12, 0)) for k in ks], [name(k) for k in existing]
    assert run(spark, bases, there, width=width) == replay(bases, there)


def scan(children, start, r):
    """Brute force of one node's children (k, c) in order of k: (j, reached, skipped)."""
    s, out = 0, []
    for k, c in sorted(children):
        j = k - start + 1 - s
        out.append((j if j <= r else None, j <= r, j <= r and c < j))
        s += out[-1][2]
    return out


def test_many_children_of_one_name(spark):
    # 200,000 blocking children of one name in ranges of 4,096: half of them are there from
    # the first, the others come at some request of the name
    import random
    rng = random.Random(5)
    n, r = 200_000, 120_000
    kids = [(k, 0 if rng.random() < 0.5 else rng.randrange(r)) for k in range(1, n + 1) if rng.random() < 0.9]
    rows = spark.createDataFrame([("a.txt", f"a_{k}.txt", k, c) for k, c in kids],
                                 "parent string, child string, k long, c long")
    starts = spark.createDataFrame([("a.txt", r, 1)], "node string, r long, start int")
    got = {x.child: (x.j if x.reached else None, x.reached, x.skipped)
           for x in _scan_children(rows, starts, 4096).collect()}
    want = scan(kids, 1, r)
    assert [got[f"a_{k}.txt"] for k, _ in kids] == want
    assert 0 < sum(w[2] for w in want) < len(kids)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(NAMES), min_size=1, max_size=30),
       st.lists(st.sampled_from(NAMES), max_size=5))
def test_random_plans(spark, bases, existing):
    assert run(spark, bases, existing) == replay(bases, existing)


def test_copies_without_child_names(spark):
    # fast path: no requested or existing name is a child of another
    bases = ["a.mp4"] * 5 + ["b.txt", "a.mp4", "c"]
    assert run(spark, bases, ["a.mp4", "c"]) == replay(bases, ["a.mp4", "c"])
