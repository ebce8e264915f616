"""Event-driven cataloguing of new archives (Structured Streaming).

The file stream source remembers which files it has seen (in the query's
checkpoint), so each micro-batch holds only archives that appeared since the
last one. Every micro-batch is scanned like a batch job and registered as scan
``stream-<stream>-<batch_id>``, where the stream is a hash of its checkpoint and
source: streams do not touch each other's scans, and a replayed batch (after a
failure) replaces its own. Only ``path``,
``length`` and ``modificationTime`` of the ``binaryFile`` source are used;
``content`` is never selected, so archive bytes are not loaded by Spark.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from zipledger.functions.ids import archive_uuid
from zipledger.functions.paths import basename, drive_label, is_directory_entry, is_target
from zipledger.plans.register import register
from zipledger.schemas import ARCHIVES, MANIFEST
from zipledger.session import clear_stage, materialize
from zipledger.sources.catalog import read_table, visible
from zipledger.sources.datasource import register_source
from zipledger.sources.fs import path_exists
from zipledger.sources.reader import read_listed, split_entries

#: Runs of a stream after which its list of registered archives is put together.
MERGE_RUNS = 16

# fixed schema of Spark's binaryFile source
BINARY_FILE = StructType([
    StructField("path", StringType(), False),
    StructField("modificationTime", TimestampType(), False),
    StructField("length", LongType(), False),
    StructField("content", BinaryType(), True),
])


def archive_stream(spark: SparkSession, folders: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
              .option("pathGlobFilter", "*.[zZ][iI][pP]"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(folders).select("path", "length", "modificationTime")


def _staged(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows`` written once, and their number."""
    seen = Observation()
    staged = materialize(rows.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return staged, seen.get["rows"]


def _per_archive(raw: DataFrame, all_files: bool) -> DataFrame:
    """One row for each archive of ``raw``: what was listed of it, whether it failed, and its ``ARCHIVE_TOTALS``."""
    target = (F.col("error_class").isNull() & ~is_directory_entry("path_in_archive")
              & is_target("path_in_archive", all_files))
    size = F.when(target, F.col("file_size"))
    return (raw.groupBy("archive_path", "drive", "archive_size", "archive_modified")
            .agg(F.max(F.col("error_class").isNotNull()).alias("failed"),
                 F.count(F.when(target, 1)).alias("entries"), F.sum(size).cast("long").alias("total_size"),
                 F.min(size).alias("min_size"), F.max(size).alias("max_size"),
                 F.sum(F.when(target, F.col("compressed_size"))).cast("long").alias("compressed"))
            .withColumn("archive_uuid", archive_uuid("archive_path"))
            .withColumn("last_modified", F.timestamp_micros("archive_modified")))


def _register_batch(catalog_path: str, sid: str, batch_id: int, raw: DataFrame, size: int, all_files: bool,
                    scan_ts: _dt.datetime | None, refresh: bool = False) -> str:
    """Publish a micro-batch: what a batch scan of its archives writes, progress rows included."""
    spark = raw.sparkSession
    ts = F.lit(scan_ts or _dt.datetime.now().replace(microsecond=0)).cast("timestamp")
    entries, errors = split_entries(raw, all_files, created_at=ts)
    found = materialize(_per_archive(raw, all_files), f"found-{sid}")
    with_entries = found.filter("entries > 0")
    archives = with_entries.select("archive_uuid", "drive", basename("archive_path").alias("archive_name"),
                                   "archive_path", F.col("archive_size").alias("file_size"),
                                   F.lit(None).cast("string").alias("file_hash"), "last_modified",
                                   ts.alias("scan_date"), F.lit(int(batch_id)).cast("long").alias("scan_seq"))
    status = F.when(F.col("failed"), "error").when(F.col("entries") > 0, "done").otherwise("no_targets")
    more = {"scan_progress": found.select("archive_path", F.col("archive_size").alias("file_size"), "last_modified",
                                          status.alias("status"))}
    if refresh:
        known = visible(spark, catalog_path, "archives", ARCHIVES).filter(F.col("scan_id") != sid)
        more["retired"] = known.join(found, "archive_path", "left_semi").select("archive_uuid").distinct()
    run_id = register(catalog_path, archives, entries, sid, errors, check_existing=False, more=more,
                      totals=with_entries, size=size)
    clear_stage(spark, f"found-{sid}", f"raw-{sid}")
    return run_id


def _refreshing_writer(catalog_path: str, all_files: bool, drive_of: Callable[[Column], Column],
                       scan_ts: _dt.datetime | None, stream: str):
    """For entry rows of the ``archive_entries`` stream: an archive that comes again replaces what is registered of it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        sid = f"stream-{stream}-{batch_id:06d}"
        modified = F.unix_micros(F.timestamp_seconds("archive_mtime"))
        raw, size = _staged(batch.withColumn("drive", drive_of(F.col("archive_path")))
                            .withColumn("archive_modified", modified)
                            .withColumn("entry_mtime", F.col("entry_mtime").cast("timestamp")), f"raw-{sid}")
        _register_batch(catalog_path, sid, batch_id, raw, size, all_files, scan_ts, refresh=True)
    return write


class _Registered:
    """The archives that a catalogue has, for the batches of one stream one after the other.

    The catalogue gets a run with each batch, so reading all of it for every batch would take longer from batch to
    batch. It is read as a whole (and staged as one table) for the first batch, and whenever a run that is not the
    stream's own has been published since; the stream's own runs are added from their folders, and staged together
    with the rest after every ``MERGE_RUNS``."""

    def __init__(self, catalog_path: str, stream: str):
        self.path, self.stream = catalog_path, stream
        self.table, self.turn = None, 0
        self.scans: set[str] = set()        # scans of the stream that are in the table
        self.fresh: dict[str, str] = {}     # those that are not: the folder of their archives
        self.manifest: set[str] = set()     # manifest files that the table and the folders stand for

    def _manifest_files(self, spark: SparkSession) -> set[str]:
        return set(read_table(spark, f"{self.path}/manifest", MANIFEST).inputFiles())

    def _stage(self, rows: DataFrame) -> None:
        self.turn += 1
        name = f"registered-{self.stream}-{self.turn % 2}"
        clear_stage(rows.sparkSession, name)   # the one before last
        self.table = materialize(rows.coalesce(1), name)
        self.scans |= set(self.fresh)
        self.fresh = {}

    def paths(self, spark: SparkSession, sid: str) -> DataFrame:
        """(archive_path) of the archives that runs of other scans than ``sid`` have registered."""
        now = self._manifest_files(spark)
        if self.table is None or now != self.manifest or sid in self.scans:
            self.scans, self.fresh, self.manifest = set(), {}, now
            self._stage(visible(spark, self.path, "archives", ARCHIVES).filter(F.col("scan_id") != sid)
                        .select("archive_path"))
        self.fresh.pop(sid, None)
        if len(self.fresh) >= MERGE_RUNS:
            self._stage(self._all(spark))
        return self._all(spark)

    def _all(self, spark: SparkSession) -> DataFrame:
        if not self.fresh:
            return self.table
        return self.table.union(spark.read.schema("archive_path string").parquet(*self.fresh.values()))

    def add(self, spark: SparkSession, sid: str, run_id: str) -> None:
        """The stream has published a run of its own."""
        folder = f"{self.path}/archives/scan_id={sid}/run_id={run_id}"
        if path_exists(folder, spark):   # else it has no archives
            self.fresh[sid] = folder
        new = self._manifest_files(spark)
        if len(new - self.manifest) == 1 and self.manifest <= new:
            self.manifest = new
        else:
            self.table = None


def _batch_writer(catalog_path: str, all_files: bool, drive_of: Callable[[Column], Column],
                  scan_ts: _dt.datetime | None, stream: str = ""):
    registered = _Registered(catalog_path, stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = F.regexp_replace("path", r"^file:", "")
        listing = batch.select(path.alias("archive_path"), F.col("length").alias("archive_size"),
                               F.unix_micros("modificationTime").alias("archive_modified"))
        listing = listing.withColumn("drive", drive_of(F.col("archive_path")))
        sid = f"stream-{stream}-{batch_id:06d}"
        # archives registered by earlier batches or scans are not read again
        listing = listing.join(registered.paths(spark, sid), "archive_path", "left_anti")
        raw, size = _staged(read_listed(listing), f"raw-{sid}")
        registered.add(spark, sid, _register_batch(catalog_path, sid, batch_id, raw, size, all_files, scan_ts))
    return write


def watch(spark: SparkSession, folders: str, catalog_path: str, checkpoint_location: str,
          all_files: bool = False, drive_of: Callable[[Column], Column] | None = None,
          available_now: bool = True, max_files_per_trigger: int | None = None,
          scan_ts: _dt.datetime | None = None, processing_time: str = "1 minute", path_style: str = "posix",
          refresh: bool = False):
    """Start the cataloguing stream; with ``available_now`` it stops when caught up.

    With ``refresh`` the stream reads the ``archive_entries`` source, which also brings archives that have changed;
    it runs until it is stopped (``folders`` are separated by commas there, and sub-folders are read)."""
    drive_of = drive_of or (lambda c: drive_label(c, path_style))
    name = hashlib.sha256(f"{checkpoint_location}\n{folders}".encode()).hexdigest()[:12]
    if refresh:
        register_source(spark)
        entries = spark.readStream.format("archive_entries").load(folders)
        return (entries.writeStream.foreachBatch(_refreshing_writer(catalog_path, all_files, drive_of, scan_ts, name))
                .option("checkpointLocation", checkpoint_location).trigger(processingTime=processing_time).start())
    stream = archive_stream(spark, folders, max_files_per_trigger)
    w = (stream.writeStream
         .foreachBatch(_batch_writer(catalog_path, all_files, drive_of, scan_ts, name))
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
