"""Packing of token sequences: shortest pack first over the length histogram.

A document longer than a sequence is cut into whole sequences and a rest, so every cut
follows from the document's own length. The histogram of piece lengths has at most one
row per length, whatever the corpus; it is packed on the driver, longest lengths first,
each into the emptiest open packing pattern, and only counts of patterns are updated.
Pieces are numbered within their length (range-partitioned, so that a length that a
third of all pieces have is numbered by many tasks) and take the places that the
patterns have for their length by that rank.

Defined results: a null or empty text is the end id alone. Rows that repeat a doc_id
are packed as documents of their own. Null ids pass through. No documents make no rows.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zipledger.llm.common import id_text, stage
from zipledger.llm.tokens import closed, default_vocabulary, encoder_of_many, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"


def _cut(vocabulary: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, encode = TaskContext.get().partitionId() << 33, encoder_of_many(vocabulary)
        for batch in batches:
            for docs in slices(batch):
                out: list[tuple] = []
                offsets, ids = closed(*encode(docs.column(1).to_pylist()), end_id)
                raw, edges = memoryview(ids).cast("B"), offsets.tolist()
                for doc_id, first, last in zip(docs.column(0).to_pylist(), edges, edges[1:]):
                    for at in range(first, last, size):
                        end = min(at + size, last)
                        out.append((doc_id, at - first, end - at, zlib.crc32(raw[4 * at:4 * end]), last - first, row))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 [x.split()[0] for x in PIECES.split(", ")])
    return run


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs that hold the histogram's pieces: longest lengths go first,
    each into the emptiest open pattern that has room."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    spaces: list[int] = []  # free tokens of open patterns, emptiest first

    def put(free: int, count: int, lengths: tuple[int, ...]) -> None:
        if not room[free]:
            heapq.heappush(spaces, -free)
        room[free].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if spaces and -spaces[0] >= length:
                free = -spaces[0]
                count, lengths = room[free].pop()
                if not room[free]:
                    heapq.heappop(spaces)
                used = min(count, left)
                if count > used:
                    put(free, count - used, lengths)
                put(free - length, used, (*lengths, length))
            else:
                used, fit = left, max(1, size // length)
                # equal pieces share a pack as long as they fit
                whole, rest = divmod(used, fit)
                if whole:
                    put(size - fit * length, whole, (length,) * fit)
                if rest:
                    put(size - rest * length, 1, (length,) * rest)
            left -= used
    return [x for packs in room.values() for x in packs]


def places(packs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, sequence of rank_from, offset): where the pieces of a length go."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, lengths in sorted(packs, reverse=True):
        offset = 0
        for length in lengths:
            out.append((length, taken[length], taken[length] + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, from 0 within each length. Hot lengths are spread over tasks."""
    spread = stage(rows.repartitionByRange("length", "doc_id", "start", "row")
                   .withColumn("part", F.spark_partition_id()), "pieces")
    counts = spread.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    here = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "start", "row"))
    return spread.withColumn("here", here).join(before, ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("here") - 1).drop("here", "before", "part")


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, size: int = 2048) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut = id_text(docs).mapInArrow(_cut(vocabulary or default_vocabulary(), end_id, size), PIECES)
    rows = stage(ranked(stage(cut, "cuts")), "ranks")  # dealing by ranges reads the cuts twice
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most ``size`` rows
    table = spark.createDataFrame(places(patterns(histogram, size)),
                                  "length long, lo long, hi long, sequence long, offset long")
    inside = (rows["length"] == table["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return rows.join(F.broadcast(table), inside).select(  # bounded by the histogram
        "doc_id", "start", rows["length"], "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
