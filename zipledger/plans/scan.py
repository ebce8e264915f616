"""The scan job: roots -> listing -> central directories -> catalogue.

One Spark job replaces the reference's per-drive threads, temporary stores
and merge: archives are spread over tasks regardless of which drive they
are on, each task writes its part of the catalogue, and the commit of the
partition replaces the merge step.
"""

from __future__ import annotations

import datetime as _dt
import time
from dataclasses import dataclass
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zipledger.functions.ids import archive_uuid
from zipledger.functions.paths import EXCLUDED_DIRECTORIES, drive_label, is_directory_entry, is_target
from zipledger.operators import quality as Q
from zipledger.operators.stats import scan_totals
from zipledger.plans.register import register
from zipledger.schemas import ARCHIVES, SCAN_PROGRESS
from zipledger.session import materialize
from zipledger.sources.catalog import published_runs, run_places, visible
from zipledger.sources.listing import dedupe_paths, list_all, list_objects, list_takeout_rows, missing, split_takeout
from zipledger.sources.reader import inner_archives, is_inner_archive, read_central_directories, split_entries


@dataclass
class ScanResult:
    listing: DataFrame
    archives: DataFrame
    entries: DataFrame
    errors: DataFrame
    rollup: DataFrame
    progress: DataFrame
    found: DataFrame   # the whole listing, with the archives that were not read

    def totals(self) -> DataFrame:
        return scan_totals(self.rollup)


def list_roots(spark: SparkSession, roots: DataFrame, mode: str = "takeout",
               excluded: Iterable[str] = EXCLUDED_DIRECTORIES,
               follow_symlinks: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(listing, roots that failed) of the archives below ``roots``.

    ``takeout`` and ``all`` walk folders that executors mount; ``objects`` lists with
    Spark's file source, for object stores. The listing is written once, so every later
    step sees the same files with the same sizes.
    """
    root_errors = None
    if mode == "takeout":
        found = materialize(list_takeout_rows(spark, roots), "takeout")
        listing, root_errors = split_takeout(found)
    elif mode == "all":
        listing = list_all(spark, roots, excluded, follow_symlinks)
    elif mode == "objects":
        listing = list_objects(spark, roots, excluded)
    else:
        raise ValueError(f"unknown listing mode {mode!r}")
    return materialize(dedupe_paths(listing), "listing"), root_errors


def labelled(listing: DataFrame, path_style: str | None) -> DataFrame:
    """Archives of roots without a given drive take the label of their own path."""
    return listing.withColumn("drive", F.coalesce("drive", drive_label("archive_path", path_style or "posix")))


def progress_of(containers: DataFrame, entries: DataFrame, errors: DataFrame) -> DataFrame:
    """``SCAN_PROGRESS`` rows of the archives that were read."""
    failed = errors.select("archive_path").distinct().withColumn("_failed", F.lit(True))
    done = entries.select("archive_path").distinct().withColumn("_done", F.lit(True))
    return (containers.join(failed, "archive_path", "left").join(done, "archive_path", "left")
            .select("archive_path", "file_size", "last_modified",
                    F.when(F.col("_failed"), "error").when(F.col("_done"), "done")
                    .otherwise("no_targets").alias("status")))


def scan(spark: SparkSession, roots: DataFrame, mode: str = "takeout", all_files: bool = False,
         excluded: Iterable[str] = EXCLUDED_DIRECTORIES, scan_ts: _dt.datetime | None = None,
         scan_seq: int = 0, skip: DataFrame | None = None, nested: bool = False,
         path_style: str | None = None, extensions: Iterable[str] | None = None,
         follow_symlinks: bool = False, unchanged: DataFrame | None = None) -> ScanResult:
    """Plan a scan of ``roots`` (``root``, ``drive``); nothing is registered.

    A root whose ``drive`` is null labels its archives by their paths (``path_style``).
    ``extensions`` are the target extensions (the video extensions by default).
    ``skip`` (column ``archive_path``) lists archives not to read at all, e.g. those
    another scan already registered; ``unchanged`` (path, size, modification time) those
    to leave out as long as they have not changed (resume). ``nested`` also reads archives
    stored inside archives, level by level until there are none, registered under the
    virtual path ``<outer>!/<member>``.
    """
    ts = F.lit(scan_ts or _dt.datetime.now().replace(microsecond=0)).cast("timestamp")
    listing, root_errors = list_roots(spark, roots, mode, excluded, follow_symlinks)
    found = listing = labelled(listing, path_style)
    if skip is not None:
        listing = listing.join(skip.select("archive_path").distinct(), "archive_path", "left_anti")
    if unchanged is not None:
        listing = Q.scan_resume(listing, unchanged)
    # the archives are read exactly once; entries, errors and rollups reuse it.
    # Only target entries and error rows are kept (filtered in the same stage),
    # so non-target entries never reach the staging table.
    file_entry = ~is_directory_entry("path_in_archive")
    wanted = F.col("error_class").isNotNull() | (file_entry & is_target("path_in_archive", all_files, extensions))
    containers, raw, level = listing, None, listing
    while True:
        rows = read_central_directories(level).withColumn("_wanted", wanted)
        rows = materialize(rows.filter(F.col("_wanted") | is_inner_archive()) if nested
                           else rows.filter("_wanted"), "raw-entries")
        kept = rows.filter("_wanted").drop("_wanted")
        raw = kept if raw is None else raw.unionByName(kept)
        if not nested or rows.filter(is_inner_archive()).isEmpty():
            break
        level = materialize(inner_archives(rows), "inner-archives")
        containers = containers.unionByName(level)
    entries, errors = split_entries(raw, True, created_at=ts)   # targets only, see above
    with_entries = entries.select("archive_path").distinct()
    archives = (containers.join(with_entries, "archive_path", "left_semi")
                .select(archive_uuid("archive_path").alias("archive_uuid"), "drive", "archive_name",
                        "archive_path", "file_size", F.lit(None).cast("string").alias("file_hash"),
                        "last_modified", ts.alias("scan_date"), F.lit(scan_seq).cast("long").alias("scan_seq")))
    progress = progress_of(containers, entries, errors)
    per_drive = (entries.groupBy("archive_path", "drive").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("drive").agg(F.count(F.lit(1)).alias("zip_count"),
                                       F.sum("n").cast("long").alias("video_count")))
    # a root without a drive and without archives is reported under its own label
    bare = roots.filter("drive is null").join(listing.select("root").distinct(), "root", "left_anti")
    drives = (roots.select("drive").filter("drive is not null").union(listing.select("drive"))
              .union(bare.select(drive_label("root", path_style or "posix").alias("drive")))).distinct()
    rollup = drives.join(per_drive, "drive", "left")
    if root_errors is not None:
        failed_roots = labelled(root_errors, path_style)
        rollup = (drives.union(failed_roots.select("drive")).distinct().join(per_drive, "drive", "left")
                  .join(failed_roots.groupBy("drive").agg(F.min("error").alias("error")), "drive", "left"))
    else:
        rollup = rollup.withColumn("error", F.lit(None).cast("string"))
    ok = F.col("error").isNull()
    rollup = rollup.select(
        "drive",
        F.when(ok, F.coalesce("zip_count", F.lit(0))).otherwise(0).cast("long").alias("zip_count"),
        F.when(ok, F.coalesce("video_count", F.lit(0))).otherwise(0).cast("long").alias("video_count"),
        "error", ok.alias("success"))
    return ScanResult(listing, archives, entries, errors, rollup, progress, found)


def metrics(res: ScanResult, seconds: float) -> DataFrame:
    """The scan's ``scan_metrics`` row."""
    arch = res.archives.agg(F.count_distinct("drive").alias("total_drives"), F.count("*").alias("total_zip_files"))
    ent = res.entries.agg(F.count("*").alias("total_video_files"),
                          F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("total_size_bytes"))
    one = F.lit(1).alias("one")   # one row each
    return (arch.select("*", one).join(ent.select("*", one), "one").drop("one")
            .withColumn("scan_duration_seconds", F.lit(float(seconds))))


def file_path(path: str = "archive_path") -> Column:
    """The file an archive is in: itself, or the outermost archive of a virtual path."""
    return F.regexp_replace(path, r"(?i)(?<=\.zip)!\d*/.*$", "")


def as_seen(spark: SparkSession, catalog_path: str, scan_id: str) -> DataFrame:
    """(archive_path, file_size, last_modified) of the files as other scans last saw them, read or refused."""
    runs = [run for run in published_runs(spark, catalog_path) if run[0] != scan_id]
    columns = ["archive_path", "file_size", "last_modified", "scan_id", "run_id"]
    rows = visible(spark, catalog_path, "scan_progress", SCAN_PROGRESS, runs).select(columns).union(
        visible(spark, catalog_path, "archives", ARCHIVES, runs).select(columns))
    state = F.struct("file_size", "last_modified")
    return (rows.join(run_places(spark, runs), ["scan_id", "run_id"])
            .groupBy("archive_path")
            .agg(F.max_by(state, "_place").alias("state")).select("archive_path", "state.*"))


def changed_or_gone(spark: SparkSession, roots: DataFrame, res: ScanResult, known: DataFrame) -> DataFrame:
    """(archive_uuid) of the ``known`` archives that the scan read again or that are not there any more.

    An archive is gone if it lies below a root of the scan, was not listed, and no file of its path is found when
    looked for. A root below which nothing at all was found retires nothing: a drive that is not mounted looks so.
    """
    known = known.select("archive_uuid", file_path().alias("file"))
    again = known.join(res.listing.select(F.col("archive_path").alias("file")), "file", "left_semi")
    live = res.found.select("root").distinct().join(roots.select("root"), "root", "left_semi")
    below = [F.col("file").startswith(r["root"].rstrip("/") + "/") for r in live.collect()]  # a row per root
    if not below:
        return again.select("archive_uuid").distinct()
    missed = known.filter(reduce(Column.__or__, below)).join(
        res.found.select(F.col("archive_path").alias("file")), "file", "left_anti")
    return again.union(missing(missed)).select("archive_uuid").distinct()


def scan_and_register(spark: SparkSession, roots: DataFrame, catalog_path: str, scan_id: str,
                      resume: bool = False, refresh: bool = False, **kw) -> ScanResult:
    """Scan and publish the result as a run of ``scan_id``.

    Archives another scan already registered are dropped from the listing, so
    they are never opened again (first registration wins; a rerun of the same
    ``scan_id`` reads its own archives again and replaces its last run). With
    ``resume``, archives that other scans found bad or without targets are left
    out too unless their size or modification time has changed.

    With ``refresh``, registered archives are compared with the listing by size and
    modification time: changed ones are read again, those whose file is gone are
    retired, and only these; the newest version of an archive is the one readers see.
    """
    started = time.time()
    if refresh:
        # as if this scan had never run: its last run, with what it retired, is replaced
        others = [run for run in published_runs(spark, catalog_path) if run[0] != scan_id]
        known = visible(spark, catalog_path, "archives", ARCHIVES, others)
        res = scan(spark, roots, unchanged=as_seen(spark, catalog_path, scan_id), **kw)
        retired = materialize(changed_or_gone(spark, roots, res, known), "retired")
        register(catalog_path, res.archives, res.entries, scan_id, res.errors, check_existing=False,
                 more={"scan_progress": res.progress, "scan_metrics": metrics(res, time.time() - started),
                       "retired": retired})
        return res
    registered = visible(spark, catalog_path, "archives", ARCHIVES).filter(
        F.col("scan_id") != scan_id).select("archive_path")
    unchanged = None
    if resume:
        unchanged = visible(spark, catalog_path, "scan_progress", SCAN_PROGRESS).filter(
            (F.col("scan_id") != scan_id) & (F.col("status") != "done"))
    res = scan(spark, roots, skip=registered, unchanged=unchanged, **kw)
    register(catalog_path, res.archives, res.entries, scan_id, res.errors, check_existing=False,
             more={"scan_progress": res.progress, "scan_metrics": metrics(res, time.time() - started)})
    return res
