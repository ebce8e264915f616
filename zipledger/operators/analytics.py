"""Roadmap data jobs over the catalogue (statistics, timeline, comparison,
categories, date filters, integrity check)."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from zipledger.functions.paths import extension
from zipledger.sources.catalog import Catalog
from zipledger.sources.slices import each_entry, sliced, told, with_place


def same_file_across_archives(entries: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    """Content (size, hash) present in more than one archive."""
    return (entries.filter(F.col(hash_col).isNotNull())
            .groupBy("file_size", F.col(hash_col).alias("file_hash"))
            .agg(F.count_distinct("archive_uuid").alias("archives"), F.count(F.lit(1)).alias("copies"))
            .filter(F.col("archives") > 1))


def archive_stats(cat: Catalog) -> DataFrame:
    """Per archive: entry count, total/min/max/avg size, compression ratio."""
    per = cat.per_archive().withColumn("avg_size", F.col("total_size").cast("double") / F.col("entries"))
    return (cat.archives.select("archive_uuid", "archive_name", "archive_path", "drive")
            .join(per, "archive_uuid")
            .withColumn("compression_ratio",
                        F.when(F.col("total_size") > 0, F.col("compressed") / F.col("total_size"))))


def timeline(entries: DataFrame, unit: str = "month", ts_col: str = "entry_mtime") -> DataFrame:
    """Entries and bytes per ``unit`` of the entry time stamp."""
    return (entries.filter(F.col(ts_col).isNotNull())
            .groupBy(F.date_trunc(unit, F.col(ts_col)).alias("period"))
            .agg(F.count(F.lit(1)).alias("entries"), F.sum("file_size").cast("long").alias("bytes")))


def filter_dates(entries: DataFrame, start=None, end=None, ts_col: str = "entry_mtime") -> DataFrame:
    """Entries with ``start <= ts < end`` (either bound optional)."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts_col) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(ts_col) < F.lit(end))
    return entries.filter(cond)


def filter_ratio(entries: DataFrame, max_ratio: float) -> DataFrame:
    """Entries compressed to at most ``max_ratio`` of their size."""
    return entries.filter((F.col("file_size") > 0)
                          & (F.col("compressed_size") / F.col("file_size") <= F.lit(max_ratio)))


def compare(left: DataFrame, right: DataFrame, key: str = "path_in_archive") -> DataFrame:
    """Entry-level diff of two archives: added, removed, changed, same.

    Entries with one path are matched in their order. Equal sizes with unequal checksums
    are changed; where a checksum is unknown, the size decides."""
    def side(df: DataFrame, name: str) -> DataFrame:
        crc = F.col("crc32") if "crc32" in df.columns else F.lit(None).cast("long")
        order = F.col("entry_ordinal") if "entry_ordinal" in df.columns else F.lit(0)
        nth = F.row_number().over(W.partitionBy(key).orderBy(order))
        return df.select(F.col(key).alias("key"), nth.alias("nth"), F.col("file_size").alias(f"{name}_size"),
                         crc.alias(f"{name}_crc"))

    j = side(left, "left").join(side(right, "right"), ["key", "nth"], "full")
    differs = (F.col("left_size") != F.col("right_size")) | F.coalesce(
        F.col("left_crc") != F.col("right_crc"), F.lit(False))
    status = (F.when(F.col("left_size").isNull(), "added").when(F.col("right_size").isNull(), "removed")
              .when(differs, "changed").otherwise("same"))
    return j.select(F.col("key").alias(key), "left_size", "right_size", status.alias("status"))


def categorize(spark: SparkSession, entries: DataFrame, mapping: Mapping[str, str],
               default: str = "other") -> DataFrame:
    """Add ``category`` by extension. The mapping is a driver-side dict of
    bounded size, so it becomes a map literal inside the projection (no join,
    no broadcast, no Python)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k.lower()), F.lit(v)]
    lookup = F.create_map(*pairs)
    return (entries.withColumn("extension", extension("path_in_archive"))
            .withColumn("category", F.coalesce(F.try_element_at(lookup, F.col("extension")), F.lit(default))))


_CRC = StructType([
    StructField("archive_path", StringType(), False),
    StructField("entry_ordinal", IntegerType(), True),
    StructField("status", StringType(), False),
    StructField("error", StringType(), True),
])


def _check_entry(opened, row) -> tuple:
    path, ordinal = row["archive_path"], row["entry_ordinal"]
    ordinal = None if pd.isna(ordinal) else int(ordinal)
    try:
        if ordinal is None:   # could not be read when it was scanned
            opened.entry(path, 0)
            return (path, ordinal, "ok", None)
        with opened.read(row) as src:  # reading to the end checks the CRC
            while src.read(1 << 20):
                pass
        return (path, ordinal, "ok", None)
    except Exception as e:
        # an archive that cannot be opened, or whose directory is needed and cannot be read, is an error
        return (path, ordinal, "error" if opened.error is not None or isinstance(e, IndexError) else "corrupt", told(e))


def integrity_check(raw: DataFrame) -> DataFrame:
    """Per archive: ``ok``, ``corrupt`` (first bad entry) or ``error`` (unreadable).

    ``raw`` are reader rows (every entry incl. non-targets, and error rows).
    Entries are checked in slices of even size on many tasks.
    """
    work = sliced(with_place(raw, "archive_path", "entry_ordinal")).mapInPandas(each_entry(_check_entry, _CRC.fieldNames()), _CRC)
    rank = F.when(F.col("status") == "error", 2).when(F.col("status") == "corrupt", 1).otherwise(0)
    return (work.groupBy("archive_path")
            .agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("checked"),
                 F.min(F.when(F.col("status") != "ok", F.col("entry_ordinal"))).alias("first_bad"))
            .select("archive_path",
                    F.when(F.col("r") == 2, "error").when(F.col("r") == 1, "corrupt").otherwise("ok").alias("status"),
                    F.when(F.col("r") == 2, F.lit(0)).otherwise(F.col("checked")).cast("long").alias("checked"),
                    "first_bad"))


_TEXT = StructType([
    StructField("archive_path", StringType(), False),
    StructField("path_in_archive", StringType(), False),
    StructField("entry_ordinal", IntegerType(), False),
    StructField("file_name", StringType(), True),
    StructField("file_size", LongType(), True),
    StructField("text", StringType(), True),
    StructField("error", StringType(), True),
])


def _read_text(encoding: str):
    def make(opened, row) -> tuple:
        key = tuple(row[c] for c in ("archive_path", "path_in_archive", "entry_ordinal", "file_name", "file_size"))
        try:
            with opened.read(row) as src:   # the whole entry, never a prefix
                return (*key, src.read().decode(encoding, errors="replace"), None)
        except Exception as e:
            return (*key, None, told(e))
    return make


def entry_texts(cat: Catalog, extensions=(".txt",), encoding: str = "utf-8") -> DataFrame:
    """Whole decoded contents of entries (``extensions=None``: of all), or why they cannot be read."""
    ent = cat.entries
    if extensions is not None:
        ent = ent.filter(extension("path_in_archive").isin([e.lower() for e in extensions]))
    ent = with_place(ent.join(cat.archives.select("archive_uuid", "archive_path"), "archive_uuid"),
                     "archive_path", "path_in_archive", "entry_ordinal", "file_name", "file_size")
    return sliced(ent).mapInPandas(each_entry(_read_text(encoding), _TEXT.fieldNames()), _TEXT)


def search_text(cat: Catalog, pattern: str, extensions=(".txt",), ignore_case: bool = False,
                encoding: str = "utf-8", errors: bool = False) -> DataFrame:
    """Entries whose whole decoded content matches ``pattern``.

    Contents are read on the executors and handed to Spark in batches of bounded bytes;
    the regular expression runs JVM-side. ``errors`` returns the entries that could not
    be read instead.
    """
    texts = entry_texts(cat, extensions, encoding)
    if errors:
        return texts.filter(F.col("error").isNotNull()).drop("text")
    hit = texts.filter(F.col("text").rlike(("(?i)" if ignore_case else "") + pattern))
    return hit.select("archive_path", "entry_ordinal", "path_in_archive", "file_name", "file_size")
