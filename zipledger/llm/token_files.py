"""Token ids as Parquet list columns, in ascending doc_id order.

Documents are range-partitioned by doc_id (one shuffle of the texts), encoded task by
task and written by Spark's Parquet writer: ``ids`` is a dictionary-encoded list
column, ``doc_id``, ``n_tokens`` and ``local_start`` are delta-encoded, row groups and
pages have set sizes and the files carry page indexes, so a reader takes the metadata
without the tokens, or the tokens of a range of documents. A document's start is the
sum of the tokens of the files before it (one small row per file) and ``local_start``.

Defined results: a null or empty text is the end id alone. Null ids come first. Rows
that repeat a doc_id are documents of their own, next to each other, ordered by a hash
of the text. No documents make no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zipledger.llm.common import id_text
from zipledger.llm.tokens import closed, default_vocabulary, encoder_of_many, slices

FILE_SCHEMA = "part int, local_start long, doc_id long, n_tokens long, ids array<int>"


def _encode(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, encode = TaskContext.get().partitionId(), 0, encoder_of_many(vocabulary)
        for batch in batches:
            for docs in slices(batch):
                offsets, ids = closed(*encode(docs.column(1).to_pylist()), end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(docs.num_rows, part), pa.int32()), pa.array(start + offsets[:-1].astype(np.int64)),
                     docs.column(0), pa.array(np.diff(offsets), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                    ["part", "local_start", "doc_id", "n_tokens", "ids"])
                start += len(ids)
    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2,
          row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode every whole text, append ``end_id`` and write the files to ``path``."""
    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    tokens = ordered.mapInArrow(_encode(vocabulary or default_vocabulary(), end_id), FILE_SCHEMA)
    writer = tokens.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    for column in ("part", "local_start", "doc_id", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """(part, before): ids in the files before each; one row per file, so a small window."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("before"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
            ["part", "local_start", "doc_id", "n_tokens", "ids_crc32"])


def digest(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    rows = files.select("part", "local_start", "doc_id", "ids").mapInArrow(
        _digest, "part int, local_start long, doc_id long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(starts(files)), "part").select(  # a row per file
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
