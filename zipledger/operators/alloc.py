"""Output-name allocation for extraction (the collision rule as a data operator).

Rule (sequential, in plan order): an entry is extracted to its base name;
while that name is taken (by an existing file or an earlier extraction) the
candidates ``<stem>_1<ext>``, ``<stem>_2<ext>``, ... are tried, where
``(stem, ext) = os.path.splitext(base name)``.

Exact distributed form. Call a name ``n`` a *node*; its candidates are ``n``
(index 0) and its children ``n_k`` (index k). Requests of one node receive
strictly increasing indices, so the i-th request of ``n`` gets index
``start + (i - 1) + (number of skipped children reached by then)``, where

* ``start`` is 1 when ``n`` exists or was taken by a request of its parent
  node before ``n``'s own first request, else 0;
* a child ``n_k`` that exists, or has its own requests, blocks index k from
  time ``B`` (always, or its first own request); it is *skipped* when the
  request of ``n`` that reaches k comes after ``B``.

The rank of each request inside its node is a two-level count (per bucket of
plan positions, then inside a bucket), so millions of copies of one name
(``metadata.json`` in every export) spread over tasks. The blocking children of
a node are scanned in ranges of k (:func:`_thresholds`): with ``s`` children
skipped before it, child k is skipped when ``s <= k - start - c`` (``c``: the
requests of ``n`` before time B, 0 if the child exists), so it maps ``s`` to
``s`` or ``s + 1``. A composition of such maps is again a row of thresholds,
one a child: the child is skipped when the count at the start of its range is
not above its threshold. Ranges find their thresholds side by side, the counts
at their starts follow by one pass over the thresholds that are still open
(:func:`_starts_of_ranges`, which keeps two numbers), and each range then adds
up its own. No task holds more than one range of a node's children.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from zipledger.operators.ranking import running
from zipledger.session import materialize

BUCKET = 1 << 20  # plan positions per rank bucket (bounds one window partition)

RANGE = 1 << 16   # child indexes scanned by one task
ALWAYS = (1 << 63) - 1   # threshold of a child that is skipped whatever came before its range

_THRESHOLDS = StructType([
    StructField("parent", StringType(), False),
    StructField("range", LongType(), False),
    StructField("child", StringType(), False),
    StructField("k", LongType(), False),
    StructField("c", LongType(), False),
    StructField("start", LongType(), False),
    StructField("r", LongType(), False),
    StructField("threshold", LongType(), False),
])

_STARTS = StructType([
    StructField("parent", StringType(), False),
    StructField("range", LongType(), False),
    StructField("at_start", LongType(), False),
])


def _ext(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def with_name_parts(df: DataFrame, col: str) -> DataFrame:
    """Add ``stem``, ``ext``, ``parent`` and ``k`` (child index under parent) of ``col``."""
    n = F.col(col)
    e = _ext(n)
    df = df.withColumn("ext", e).withColumn("stem", F.expr(f"substring({col}, 1, length({col}) - length(ext))"))
    g1 = F.regexp_extract("stem", r"(?s)^(.+)_([1-9][0-9]*)\z", 1)
    g2 = F.regexp_extract("stem", r"(?s)^(.+)_([1-9][0-9]*)\z", 2)
    k = F.when(g2 != "", g2.try_cast("bigint"))
    valid = (g2 != "") & ((F.col("ext") == "") | g1.rlike(r"[^.]")) & k.isNotNull()
    return (df.withColumn("parent", F.when(valid, F.concat(g1, F.col("ext"))))
            .withColumn("k", F.when(valid, k)))


def _candidate(stem: Column, ext: Column, k: Column, node: Column) -> Column:
    return F.when(k == 0, node).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), ext))


def _rank_in_node(requests: DataFrame) -> DataFrame:
    """1-based rank ``j`` of each request inside its node, in plan order."""
    b = requests.withColumn("bucket", F.floor(F.col("plan_pos") / BUCKET))
    counts = b.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("n"))
    wprev = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("node", "bucket", F.coalesce(F.sum("n").over(wprev), F.lit(0)).alias("off"))
    wloc = Window.partitionBy("node", "bucket").orderBy("plan_pos")
    return (b.withColumn("loc", F.row_number().over(wloc))
            .join(offs, ["node", "bucket"])
            .withColumn("j", F.col("off") + F.col("loc")).drop("loc", "off"))


def _count_before(requests: DataFrame, markers: DataFrame) -> DataFrame:
    """For markers (parent, child, pos): number of the parent's requests before pos."""
    req = requests.select(F.col("node").alias("parent"), "bucket", F.col("plan_pos").alias("pos"),
                          F.lit(None).cast("string").alias("child"), F.lit(0).alias("is_marker"))
    mk = markers.select("parent", F.floor(F.col("pos") / BUCKET).alias("bucket"), "pos", "child",
                        F.lit(1).alias("is_marker"))
    u = req.unionByName(mk)
    return (running(u, "parent", "bucket", ["pos"], 1 - F.col("is_marker"))
            .filter(F.col("is_marker") == 1).select("parent", "child", F.col("running").alias("c")))


def _thresholds(group: pd.DataFrame) -> pd.DataFrame:
    """``threshold`` of each child of one range of one node.

    The t-th child of a range is skipped from the count ``s`` at the range's start when
    ``s`` and the earlier skips of the range do not exceed ``k - start - c``. The largest
    such ``s`` is the free number of rank ``k - start - c - t`` among the numbers that no
    earlier child has taken, and is taken by it: thresholds of a range are distinct.
    Counts at the start lie between 0 and ``before``, the children of earlier ranges, so
    thresholds outside are only counted (-1: never skipped, ``ALWAYS``)."""
    group = group.sort_values("k")
    before = int(group["before"].iloc[0])
    taken, below, out = [], 0, []   # taken numbers from 0 to before, in order; how many lie below 0
    for t, (k, start, c) in enumerate(zip(group["k"], group["start"], group["c"])):
        rank = int(k) - int(start) - int(c) - t + below
        if rank < 0:
            below += 1
            out.append(-1)
            continue
        lo, hi = 0, len(taken)   # taken[i] - i free numbers lie below taken[i]
        while lo < hi:
            mid = (lo + hi) // 2
            if taken[mid] - mid > rank:
                hi = mid
            else:
                lo = mid + 1
        if rank + lo > before:
            out.append(ALWAYS)
        else:
            taken.insert(lo, rank + lo)
            out.append(rank + lo)
    return group.assign(threshold=out)[_THRESHOLDS.fieldNames()]


def _starts_of_ranges(batches):
    """Skips before each range, from rows (parent, range, threshold, n) in that order."""
    node = part = None
    at_start = inside = 0
    for pdf in batches:
        out = []
        for parent, rng, threshold, n in zip(pdf["parent"], pdf["range"], pdf["threshold"], pdf["n"]):
            if parent != node:
                node, part, at_start, inside = parent, None, 0, 0
            if rng != part:
                part, at_start, inside = rng, at_start + inside, 0
                out.append((node, int(part), at_start))
            if threshold >= at_start:
                inside += int(n)
        yield pd.DataFrame(out, columns=_STARTS.fieldNames())


def _scan_children(children: DataFrame, starts: DataFrame, width: int) -> DataFrame:
    """(parent, child, reached, skipped, j) of every blocking child (parent, child, k, c).

    ``j`` is the request of the parent that would get index k. Beyond the ``r``-th it is
    never reached; as j does not fall from child to child, nothing after it is either, so
    the skips counted beyond that point touch no one."""
    ranged = (children.join(starts.withColumnRenamed("node", "parent"), "parent")
              .withColumn("range", F.floor(F.col("k") / width).cast("long")))
    sizes = ranged.groupBy("parent", "range").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("parent").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("parent", "range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    found = materialize(ranged.join(sizes, ["parent", "range"])
                        .select("parent", "range", "child", "k", "c", F.col("start").cast("long").alias("start"),
                                "r", "before")
                        .groupBy("parent", "range").applyInPandas(_thresholds, _THRESHOLDS), "alloc-thresholds")
    several = (found.groupBy("parent").agg(F.min("range").alias("_a"), F.max("range").alias("_b"))
               .filter("_a < _b").select("parent"))
    open_rows = (found.join(several, "parent", "left_semi")
                 .groupBy("parent", "range", "threshold").agg(F.count(F.lit(1)).alias("n"))
                 .repartition("parent").sortWithinPartitions("parent", "range"))
    at = open_rows.mapInPandas(_starts_of_ranges, _STARTS)
    inside = Window.partitionBy("parent", "range").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    counted = (found.join(at, ["parent", "range"], "left")
               .withColumn("at_start", F.coalesce("at_start", F.lit(0)))
               .withColumn("s", F.col("at_start") + F.coalesce(
                   F.sum((F.col("threshold") >= F.col("at_start")).cast("long")).over(inside), F.lit(0)))
               .withColumn("j", F.col("k") - F.col("start") + 1 - F.col("s")))
    reached = F.col("j") <= F.col("r")
    return counted.select("parent", "child", "j", reached.alias("reached"),
                          (reached & (F.col("c") < F.col("j"))).alias("skipped"))


def allocate(plan: DataFrame, existing: DataFrame | None = None, base_col: str = "base",
             width: int = RANGE) -> DataFrame:
    """Add ``out_name`` to ``plan`` (``plan_pos`` unique, ``base_col`` = wanted name).

    ``existing`` (column ``name``) lists names already present in the output
    folder; ``width`` is the number of child indexes that one task scans.
    """
    spark = plan.sparkSession
    req = materialize(_rank_in_node(plan.select("plan_pos", F.col(base_col).alias("node"))), "alloc-req")
    stats = req.groupBy("node").agg(F.count(F.lit(1)).alias("r"), F.min("plan_pos").alias("first_pos"))
    if existing is None:
        existing = spark.createDataFrame([], "name string")
    ex = existing.select(F.col("name").alias("node")).distinct().withColumn("exists", F.lit(True))
    # every name that can block a candidate: requested bases and existing names
    blockers = (stats.select("node", "first_pos").join(ex, "node", "full")
                .withColumn("exists", F.coalesce("exists", F.lit(False))))
    blockers = with_name_parts(blockers, "node").filter(F.col("parent").isNotNull())
    blockers = blockers.join(stats.select(F.col("node").alias("parent")), "parent", "left_semi")
    node_ex = stats.select("node", "r").join(ex, "node", "left").select(
        "node", "r", F.coalesce("exists", F.lit(False)).alias("exists"))
    if blockers.isEmpty():
        # no requested or existing name is a candidate of another requested
        # name: the i-th copy of a name gets index i-1 (i if it exists)
        starts = node_ex.select("node", "r", F.col("exists").cast("int").alias("start"))
        return _assign(plan, req, starts, None)
    blockers = materialize(blockers, "alloc-blockers")
    markers = blockers.filter(~F.col("exists")).select("parent", F.col("node").alias("child"),
                                                       F.col("first_pos").alias("pos"))
    counted = _count_before(req, markers)
    children = (blockers.select("parent", F.col("node").alias("child"), "k", "exists")
                .join(counted, ["parent", "child"], "left")
                .select("parent", "child", "k",
                        F.when(F.col("exists"), F.lit(0)).otherwise(F.col("c")).cast("long").alias("c")))
    children = materialize(children, "alloc-children")
    # start(n): exists, or taken by the parent before its own first request.
    # Iterate to the fixed point: nodes whose parent has no requests are right
    # after one round, their children after two, ... (depth of `_k` nesting).
    taken = spark.createDataFrame([], "node string")
    while True:
        starts = (node_ex.join(taken.withColumn("taken", F.lit(True)), "node", "left")
                  .select("node", "r", (F.col("exists") | F.coalesce("taken", F.lit(False))).cast("int")
                          .alias("start")))
        scanned = materialize(_scan_children(children, starts, width), "alloc-scan")
        new_taken = scanned.filter(F.col("reached") & ~F.col("skipped")).select(F.col("child").alias("node"))
        if new_taken.exceptAll(taken).isEmpty() and taken.exceptAll(new_taken).isEmpty():
            break
        taken = new_taken
    skips = scanned.filter(F.col("skipped")).select(F.col("parent").alias("node"), "j")
    return _assign(plan, req, starts, skips)


def _assign(plan: DataFrame, req: DataFrame, starts: DataFrame, skips: DataFrame | None) -> DataFrame:
    """Index of each request = start + rank - 1 + skipped children reached so far."""
    asked = req.select("plan_pos", "node", "j")
    if skips is None:
        asked = asked.withColumn("running", F.lit(0))
    else:   # a child skipped at the rank of a request comes before it
        both = asked.withColumn("skip", F.lit(0)).unionByName(
            skips.select(F.lit(None).cast("long").alias("plan_pos"), "node", F.col("j").cast("long").alias("j"),
                         F.lit(1).alias("skip")))
        both = both.withColumn("bucket", F.floor(F.col("j") / BUCKET))
        asked = running(both, "node", "bucket", [F.col("j"), F.desc("skip")], F.col("skip")).filter("skip = 0")
    names = with_name_parts(asked.select("plan_pos", "node", "j", "running"), "node")
    out = (names.join(starts, "node")
           .withColumn("idx", F.col("start") + F.col("j") - 1 + F.col("running"))
           .select("plan_pos", _candidate(F.col("stem"), F.col("ext"), F.col("idx"), F.col("node"))
                   .alias("out_name")))
    return plan.join(out, "plan_pos")
