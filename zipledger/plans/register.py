"""The catalogue sink: one run of a scan, published at once.

Layout: ``<catalog>/entries``, ``archives``, ``archive_totals``, ``scan_errors``, ``scan_progress`` and
``scan_metrics``, each Parquet partitioned by ``scan_id`` and ``run_id``, and
``<catalog>/manifest``. A run writes into new ``run_id`` folders, and the row it
appends to the manifest at the end makes all its tables visible together; the run
of the same scan that was visible before is replaced as a whole, so a rerun leaves
no stale archives, entries or errors behind. A failed run is never seen.

``expire`` removes the folders of runs that no reader sees any more. A path registered by
an earlier scan is not registered again, unless a refresh retires it. Entries are
range-partitioned on ``(archive_uuid, entry_ordinal)`` before the write: files come
out sorted by archive, so Parquet min/max statistics prune uuid lookups, and an
archive holding a large share of all entries is split over several ranges instead
of landing in one writer task.
"""

from __future__ import annotations

import datetime as _dt
import uuid as _uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zipledger.schemas import ARCHIVE_TOTALS, ARCHIVES, ENTRIES, MANIFEST, SCAN_ERRORS
from zipledger.sources.catalog import (ARCHIVE_COLS, ENTRY_COLS, _with_run, in_runs, published_runs, read_table,
                                       totals_of, visible)
from zipledger.sources.fs import _hadoop, path_exists


#: Entries that are written as one file, by one task.
FILE_ROWS = 1 << 16


def _write(df: DataFrame, path: str, scan_id: str, run_id: str) -> None:
    (df.withColumn("scan_id", F.lit(scan_id)).withColumn("run_id", F.lit(run_id))
     .write.mode("append").partitionBy("scan_id", "run_id").parquet(path))


def _write_all(tables: dict[str, DataFrame], catalog_path: str, scan_id: str, run_id: str) -> None:
    """Write tables of a run that do not depend on each other at the same time; raises what the first of them raised."""
    with ThreadPoolExecutor(len(tables)) as pool:
        jobs = [pool.submit(inheritable_thread_target(rows.sparkSession)(_write), rows, f"{catalog_path}/{name}", scan_id, run_id)
                for name, rows in tables.items()]
    for job in jobs:
        job.result()


def register(catalog_path: str, archives: DataFrame, entries: DataFrame, scan_id: str,
             errors: DataFrame | None = None, check_existing: bool = True,
             more: dict[str, DataFrame] | None = None, totals: DataFrame | None = None, size: int | None = None) -> str:
    """Write one run of a scan, publish it and return its run id.

    Archives without any entry are not registered; a run without rows is published
    all the same. An archive path already registered by *another* scan is skipped
    with its entries (first registration wins, as a unique path constraint would
    do), so readers never have to resolve duplicates. ``check_existing=False`` is
    for callers that already removed registered archives from their input (the scan
    job filters its listing). ``more`` are further tables of the run by name.

    A caller that has added up the entries already gives ``totals`` (``ARCHIVE_TOTALS``
    rows of the archives with entries) and only those ``archives``; the tables then do not
    follow from each other and are written side by side. ``size`` is the most rows
    ``entries`` can have: up to ``FILE_ROWS`` they make one sorted file, without ranges.
    """
    spark = entries.sparkSession
    run_id = _uuid.uuid4().hex
    if check_existing:
        taken = visible(spark, catalog_path, "archives", ARCHIVES).filter(
            F.col("scan_id") != scan_id).select("archive_uuid")
        entries = entries.join(taken, "archive_uuid", "left_anti")
    ent = entries.select(*ENTRY_COLS)
    small = size is not None and size <= FILE_ROWS
    ent = ent.coalesce(1) if small else ent.repartitionByRange("archive_uuid", "entry_ordinal")
    ent = ent.sortWithinPartitions("archive_uuid", "entry_ordinal")
    tables = dict(more or {})
    if errors is not None:
        errors = errors.select(*SCAN_ERRORS.fieldNames())
        tables["scan_errors"] = errors.coalesce(1) if small else errors
    if totals is not None:
        tables |= {"entries": ent, "archive_totals": totals.select(*ARCHIVE_TOTALS.fieldNames()),
                   "archives": archives.select(*ARCHIVE_COLS)}
        _write_all(tables, catalog_path, scan_id, run_id)
    else:
        _write(ent, f"{catalog_path}/entries", scan_id, run_id)
        run = [(scan_id, run_id)]
        rows = in_runs(read_table(spark, f"{catalog_path}/entries", _with_run(ENTRIES)), run)
        _write(totals_of(rows), f"{catalog_path}/archive_totals", scan_id, run_id)
        written = in_runs(read_table(spark, f"{catalog_path}/archive_totals", _with_run(ARCHIVE_TOTALS)), run)
        _write(archives.join(written, "archive_uuid", "left_semi").select(*ARCHIVE_COLS),
               f"{catalog_path}/archives", scan_id, run_id)
        for name, rows in tables.items():
            _write(rows, f"{catalog_path}/{name}", scan_id, run_id)
    row = spark.range(0, 1, 1, 1).select(F.lit(scan_id).alias("scan_id"), F.lit(run_id).alias("run_id"),
                                         F.lit(_dt.datetime.now()).alias("published_at"))
    row.write.mode("append").parquet(f"{catalog_path}/manifest")
    return run_id


def expire(spark: SparkSession, catalog_path: str, older_than: _dt.timedelta = _dt.timedelta(days=1)) -> list[str]:
    """Remove the run folders that no reader sees: replaced runs, and runs that failed before they were published.

    Only folders not written to for ``older_than`` go, so a scan under way and queries planned on the run before
    keep their files. The manifest is then rewritten to one file with a row per scan: the new file is there before
    the old ones go, and readers take the last row of a scan however often it is there. Returns the run ids removed.
    """
    runs = set(published_runs(spark, catalog_path))
    root, files = _hadoop(spark, catalog_path)
    latest = (_dt.datetime.now() - older_than).timestamp() * 1000
    gone = set()
    for folder in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "*/scan_id=*/run_id=*")) or []:
        run = tuple(unquote(p.getName().split("=", 1)[1]) for p in (folder.getPath().getParent(), folder.getPath()))
        newest = max([folder.getModificationTime(), *[f.getModificationTime() for f in files.listStatus(folder.getPath())]])
        if run not in runs and newest <= latest:
            files.delete(folder.getPath(), True)
            gone.add(run[1])
    _compact_manifest(spark, catalog_path, sorted(runs))
    return sorted(gone)


def _compact_manifest(spark: SparkSession, catalog_path: str, runs: list[tuple[str, str]]) -> None:
    path = f"{catalog_path}/manifest"
    if not path_exists(path, spark):
        return
    folder, files = _hadoop(spark, path)
    old = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().endswith(".parquet")]
    if len(old) > 1:
        rows = in_runs(read_table(spark, path, MANIFEST), runs).collect()  # a row per scan
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(path)
        for name in old:
            files.delete(name, False)
