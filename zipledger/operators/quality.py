"""Catalogue quality jobs: duplicates, validation, preview, resume, metrics.

These are documented in the reference (columns exist, README promises them)
without code; they are built from that intent as plain DataFrame plans.
Hashing reads entry bytes on the executors and is limited to entries whose
size and checksum collide with another entry's, so most entries are never read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zipledger.schemas import HASHED
from zipledger.sources.catalog import Catalog
from zipledger.sources.slices import each_entry, sliced, told, with_place

_KEY = ["archive_path", "path_in_archive", "entry_ordinal", "archive_uuid", "file_size"]
_HASH_COLS = [f.name for f in HASHED.fields]


def duplicate_groups(entries: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    """Groups of entries with equal (size, content hash) and more than one copy."""
    return (entries.filter(F.col(hash_col).isNotNull())
            .groupBy("file_size", F.col(hash_col).alias("file_hash"))
            .agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("archive_uuid").alias("archives"))
            .filter(F.col("copies") > 1))


def size_collisions(entries: DataFrame) -> DataFrame:
    """Entries whose size and checksum occur more than once (the only duplicate candidates).

    The checksum of the central directory costs no read; where it is unknown (null), the
    size alone decides."""
    if "crc32" not in entries.columns:
        entries = entries.withColumn("crc32", F.lit(None).cast("long"))
    sizes = entries.groupBy("file_size").agg(
        F.count(F.lit(1)).alias("_n"), F.count("crc32").alias("_known")).filter("_n > 1")
    sums = entries.groupBy("file_size", "crc32").agg(F.count(F.lit(1)).alias("_m"))
    # of a size that has entries without a checksum, every entry is a candidate
    pairs = sums.join(sizes, "file_size").filter((F.col("_m") > 1) | (F.col("_known") < F.col("_n")))
    pairs = pairs.select(F.col("file_size").alias("_size"), F.col("crc32").alias("_crc"))
    return entries.join(pairs, (F.col("file_size") == F.col("_size")) & F.col("crc32").eqNullSafe(F.col("_crc")),
                        "left_semi")


def _hash_entry(opened, row) -> tuple:
    key = (row["archive_path"], row["path_in_archive"], int(row["entry_ordinal"]), row["archive_uuid"], row["file_size"])
    try:
        h = hashlib.sha256()
        with opened.read(row) as src:
            while chunk := src.read(1 << 20):
                h.update(chunk)
        return (*key, h.hexdigest(), None)
    except Exception as e:
        return (*key, None, told(e))


def hash_entries(entries: DataFrame) -> DataFrame:
    """sha256 of entry contents; entries that cannot be read have an error message."""
    for name, kind in (("archive_uuid", "string"), ("file_size", "long")):
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast(kind))
    return sliced(with_place(entries, *_KEY)).mapInPandas(each_entry(_hash_entry, _HASH_COLS), HASHED)


def hashed_candidates(cat: Catalog) -> DataFrame:
    """Content hashes (or errors) of all entries that may have a duplicate."""
    ent = cat.entries.join(cat.archives.select("archive_uuid", "archive_path"), "archive_uuid")
    return hash_entries(size_collisions(ent))


def duplicates_by_content(cat: Catalog, errors: bool = False) -> DataFrame:
    """Duplicate groups for a catalogue without stored hashes (hash on demand).

    ``errors`` returns the candidates that could not be read instead."""
    hashed = hashed_candidates(cat)
    if errors:
        return hashed.filter(F.col("content_hash").isNull()).select(
            "archive_path", "path_in_archive", "entry_ordinal", "error_message")
    return duplicate_groups(hashed, "content_hash")


# ---- validation (B-3) -----------------------------------------------------------
def orphan_entries(cat: Catalog) -> DataFrame:
    return cat.entries.join(cat.archives.select("archive_uuid"), "archive_uuid", "left_anti")


def empty_archives(cat: Catalog) -> DataFrame:
    return cat.archives.join(cat.entries.select("archive_uuid"), "archive_uuid", "left_anti")


def duplicate_paths(archives: DataFrame) -> DataFrame:
    return (archives.groupBy("archive_path").agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def missing_archives(cat: Catalog, listing: DataFrame) -> DataFrame:
    """Registered archives whose file is no longer listed."""
    return cat.archives.join(listing.select("archive_path"), "archive_path", "left_anti")


def size_drift(cat: Catalog, listing: DataFrame) -> DataFrame:
    """Registered archives whose size on disk differs from the catalogue."""
    cur = listing.select("archive_path", F.col("file_size").alias("size_now"))
    return (cat.archives.join(cur, "archive_path")
            .filter(~F.col("file_size").eqNullSafe(F.col("size_now")))
            .select("archive_path", "file_size", "size_now"))


# ---- preview / resume / metrics (B-4, B-5, B-6) -----------------------------------
def scan_resume(listing: DataFrame, progress: DataFrame) -> DataFrame:
    """Listed archives that ``progress`` (``SCAN_PROGRESS`` rows) does not have as they are
    now: what a resumed scan still has to do."""
    seen = progress.select("archive_path", F.col("file_size").alias("_size"),
                           F.col("last_modified").alias("_mtime")).distinct()
    same = ((listing["archive_path"] == seen["archive_path"]) & listing["file_size"].eqNullSafe(F.col("_size"))
            & listing["last_modified"].eqNullSafe(F.col("_mtime")))
    return listing.join(seen, same, "left_anti")
