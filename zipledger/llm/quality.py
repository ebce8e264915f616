"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-grams models are counted: one of target text (documents labelled as good, at
most ``SAMPLE`` rows of the training folds, in hash order) and one of the raw corpus (all
documents, whole texts). Words and word pairs share ``BUCKETS`` hashed counters, so both
models have a fixed size. A document's weight is the log ratio of its probability under the
two, and a sample without replacement in proportion to the weights is the top k of weight
plus Gumbel noise. The noise is a hash of the doc_id and a seed, so runs agree.

The top k of all rows is found without a global sort in one task: rows are range-partitioned
by their key, and counts of partitions tell which one holds the last row kept.

Defined results: a null or empty text, or one without words, has weight 0. Rows that repeat
a doc_id have the same noise. Null ids share one noise value. Labels that are null or lack a
document are not used; without good labels all weights are 0 and the sample is uniform. No
documents make no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zipledger.llm.common import id_text, stage
from zipledger.llm.words import gram_hashes, groups, mix, texts_of, word_hashes

BUCKETS = 1 << 14
#: Labelled rows of which the target model is counted, at most.
SAMPLE = 20_000
#: Share of documents kept, and the seed of the noise.
SHARE = 0.85
SEED = 7


def _buckets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(counter of each word and pair, text of each), some texts at a time."""
    for a, b in groups(texts):
        words, firsts = word_hashes([t.lower() for t in texts[a:b]])
        owner = np.repeat(np.arange(a, b), np.diff(firsts))
        pairs = np.flatnonzero(owner[1:] == owner[:-1])
        counters = np.concatenate([words, gram_hashes(words, 2)[pairs]]) % np.uint64(BUCKETS)
        yield counters.astype(np.int64), np.concatenate([owner, owner[pairs]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for counters, _ in _buckets(texts_of(batch.column(1))):
            total += np.bincount(counters, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["b", "n"])


def model(docs: DataFrame) -> np.ndarray:
    """Smoothed probability of each counter; BUCKETS numbers, summed by Spark."""
    counts = id_text(docs).mapInArrow(_count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    total = np.ones(BUCKETS)
    for b, n in counts.collect():  # at most BUCKETS rows
        total[b] += n
    return total / total.sum()


def target_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    good = known.dropna().filter((F.col("quality") == 1) & (fold != 1)).select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return id_text(docs).join(F.broadcast(chosen), "doc_id", "left_semi")  # bounded by ``sample``


def _weigh(ratio: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.zeros(batch.num_rows)
            for counters, owner in _buckets(texts_of(batch.column(1))):
                weight += np.bincount(owner, ratio[counters], minlength=batch.num_rows)
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            uniform = ((mix(mix(ids + np.uint64(seed)) ^ np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5) / 2**53
            key = weight - np.log(-np.log(uniform))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(key)],
                                             ["doc_id", "log_weight", "gumbel_key"])
    return run


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, sample: int = SAMPLE,
             seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept): the sample is the ``kept`` rows, ``share`` of all."""
    raw, target = model(docs), model(target_rows(docs, labels, sample))
    ratio = np.log(target) - np.log(raw)
    if np.ptp(target) == 0:  # nothing was counted
        ratio = np.zeros(BUCKETS)
    rows = id_text(docs).mapInArrow(_weigh(ratio, seed), "doc_id long, log_weight double, gumbel_key double")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "weights")  # ranges read it twice
    order = [F.desc("gumbel_key"), F.asc("doc_id"), F.asc("row")]
    dealt = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "keys")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    wanted = int(share * (counts.agg(F.sum("n")).first()[0] or 0))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row per partition
    parts = counts.select("part", "n", F.coalesce(before, F.lit(0)).alias("before"))
    edge = parts.filter((F.col("before") < wanted) & (F.col("before") + F.col("n") > wanted)).first()
    whole = parts.select("part", (F.col("before") + F.col("n") <= wanted).alias("all"))
    if edge is None:
        last = F.lit(False)
    else:  # the last row kept, in the one partition that is cut
        here = dealt.filter(F.col("part") == edge["part"]).orderBy(*order).limit(wanted - edge["before"])
        least = here.orderBy(F.asc("gumbel_key"), F.desc("doc_id"), F.desc("row")).first()
        same_id = F.coalesce(F.col("doc_id"), F.lit(-1 << 63))
        last_id = -1 << 63 if least["doc_id"] is None else least["doc_id"]
        last = (F.col("part") == edge["part"]) & (
            (F.col("gumbel_key") > least["gumbel_key"]) | (F.col("gumbel_key") == least["gumbel_key"]) & (
                (same_id < last_id) | (same_id == last_id) & (F.col("row") <= least["row"])))
    return dealt.join(F.broadcast(whole), "part").select(  # a row per partition
        "doc_id", "log_weight", "gumbel_key", (F.col("all") | last).alias("kept"))
