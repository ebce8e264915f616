"""Catalogue statistics: summary, per-archive counts, per-drive rollups.

Counts and sums come from the totals that the sink keeps per archive; a catalogue
without them pre-aggregates its entries per ``archive_uuid`` (map-side partial
aggregation, then one shuffle on a well-spread key) before they meet the
archive rows, so a drive or an archive holding a large share of all entries
never gathers its entries in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zipledger.functions.paths import is_target
from zipledger.functions.text import size_gb
from zipledger.sources.catalog import Catalog


def summary(cat: Catalog) -> DataFrame:
    """One row: drives, zip_files, video_files, total_size (bytes), total_size_gb.

    Archives and totals (or entries) are scanned once and folded by a single global
    aggregation over their union (no join); an empty catalogue gives zeros.
    """
    a = cat.archives.select(F.lit(1).alias("is_archive"), F.col("drive"), F.lit(0).cast("long").alias("n"),
                            F.lit(None).cast("long").alias("size"))
    n, size = (F.lit(1), "file_size") if cat.totals is None else (F.col("entries"), "total_size")
    e = (cat.entries if cat.totals is None else cat.totals).select(
        F.lit(0).alias("is_archive"), F.lit(None).cast("string").alias("drive"), n.cast("long").alias("n"),
        F.col(size).alias("size"))
    both = a.unionByName(e)
    total = F.coalesce(F.sum("size"), F.lit(0)).cast("long")
    return both.agg(
        F.count_distinct("drive").alias("drives"),
        F.coalesce(F.sum("is_archive"), F.lit(0)).cast("long").alias("zip_files"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("video_files"),
        total.alias("total_size"),
        size_gb(total).alias("total_size_gb"),
    )


def entry_counts(cat: Catalog) -> DataFrame:
    return cat.per_archive().select("archive_uuid", F.col("entries").alias("file_count"))


def archive_info(cat: Catalog, uuid: str) -> DataFrame:
    """(archive_path, archive_name, drive, file_count) of one archive; no row if absent."""
    arch = cat.archives.filter(F.col("archive_uuid") == uuid)
    cnt = entry_counts(cat).filter(F.col("archive_uuid") == uuid)
    return (arch.join(cnt, "archive_uuid", "left")
            .select("archive_path", "archive_name", "drive",
                    F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count")))


def list_archives(cat: Catalog, limit: int | None = None) -> DataFrame:
    """Archives with entry counts ordered by name, optional limit.

    The order needs no counts, so a limit is applied first and only the entries of
    those archives are counted."""
    if limit and limit > 0:
        top = cat.archives.orderBy("archive_name", "archive_path").limit(limit)
        if cat.totals is None:
            cat = Catalog(top, cat.entries.join(top.select("archive_uuid"), "archive_uuid", "left_semi"))
        else:
            cat = Catalog(top, cat.entries, cat.totals)
    res = (cat.archives.join(entry_counts(cat), "archive_uuid", "left")
           .select("archive_name", "drive", "archive_uuid",
                   F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"),
                   "archive_path")
           .orderBy("archive_name", "archive_path"))
    return res


def drive_rollup(cat: Catalog, roots: DataFrame | None = None, all_files: bool = False,
                 errors: DataFrame | None = None) -> DataFrame:
    """Per drive: archives with at least one target entry, target entries, error.

    ``roots`` (column ``drive``) lists every drive that was scanned so drives
    without archives report zeros; ``errors`` (``drive``, ``error``) marks
    drives whose root could not be listed.
    """
    per_archive = (cat.entries.filter(is_target("path_in_archive", all_files))
                   .groupBy("archive_uuid").agg(F.count(F.lit(1)).alias("n")))
    per_drive = (per_archive.join(cat.archives.select("archive_uuid", "drive"), "archive_uuid")
                 .groupBy("drive").agg(F.count(F.lit(1)).alias("zip_count"),
                                       F.sum("n").cast("long").alias("video_count")))
    drives = roots.select("drive").distinct() if roots is not None else cat.archives.select("drive").distinct()
    out = drives.join(per_drive, "drive", "left")
    if errors is not None:
        out = out.join(errors.groupBy("drive").agg(F.min("error").alias("error")), "drive", "left")
    else:
        out = out.withColumn("error", F.lit(None).cast("string"))
    return out.select("drive",
                      F.when(F.col("error").isNull(), F.coalesce("zip_count", F.lit(0))).otherwise(0)
                      .cast("long").alias("zip_count"),
                      F.when(F.col("error").isNull(), F.coalesce("video_count", F.lit(0))).otherwise(0)
                      .cast("long").alias("video_count"),
                      "error",
                      F.col("error").isNull().alias("success"))


def scan_totals(rollup: DataFrame) -> DataFrame:
    """Totals over successful drives only (failed drives do not count)."""
    return rollup.agg(
        F.coalesce(F.sum(F.when(F.col("success"), F.col("zip_count"))), F.lit(0)).cast("long")
        .alias("total_zips"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("video_count"))), F.lit(0)).cast("long")
        .alias("total_videos"),
        F.count(F.lit(1)).alias("drives"),
        F.coalesce(F.sum(F.col("success").cast("int")), F.lit(0)).cast("long").alias("drives_ok"),
    )


def extract_tally(results: DataFrame) -> DataFrame:
    """Per archive and overall (``archive_path`` NULL): extracted and error counts."""
    ok = (F.col("status") == "ok").cast("long")
    return (results.rollup("archive_path")
            .agg(F.sum(ok).alias("extracted"), F.sum(1 - ok).alias("errors"))
            .select("archive_path", F.coalesce("extracted", F.lit(0)).cast("long").alias("extracted"),
                    F.coalesce("errors", F.lit(0)).cast("long").alias("errors")))
