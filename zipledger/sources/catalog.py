"""The catalogue: an ``archives`` and an ``entries`` DataFrame.

On storage every table of the catalogue is Parquet partitioned by ``scan_id`` and
``run_id`` (written by :mod:`zipledger.plans.register`), and ``manifest`` has one
row per published run. ``archive_totals`` has what the entries of each archive add up to,
so that counts and sums read no entries. Readers see, of every scan, the run published last: all of
it or nothing of it, whatever a running or failed scan has written. ``retired`` names
archives that a refresh found changed or gone; rows that earlier runs have of them are
not seen any more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from zipledger.schemas import ARCHIVE_TOTALS, ARCHIVES, ENTRIES, MANIFEST, RETIRED
from zipledger.sources.fs import partitions_of, path_exists

ARCHIVE_COLS = ["archive_uuid", "drive", "archive_name", "archive_path", "file_size",
                "file_hash", "last_modified", "scan_date", "scan_seq"]
ENTRY_COLS = ["archive_uuid", "file_name", "file_size", "path_in_archive", "entry_ordinal",
              "file_hash", "created_at", "compressed_size", "entry_mtime", "crc32",
              "header_offset", "compress_type"]


def _with_run(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("scan_id", StringType(), True),
                       StructField("run_id", StringType(), True)])


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table, empty where nothing has been written yet."""
    if not path_exists(path, spark):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def published_runs(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(scan_id, run_id) of the runs that readers see, the last of each scan, in the order they were published.

    They come to the driver (a row per scan), so that they are literals in the partition
    filters of every query: files of replaced and failed runs are not even listed for a task."""
    last = (read_table(spark, f"{path}/manifest", MANIFEST).coalesce(1).groupBy("scan_id")
            .agg(F.max(F.struct("published_at", "run_id")).alias("last")).select("last.*", "scan_id"))
    return [(r["scan_id"], r["run_id"]) for r in sorted(last.collect())]


def in_runs(rows: DataFrame, runs: list[tuple[str, str]]) -> DataFrame:
    if not runs:
        return rows.filter(F.lit(False))
    return rows.filter(F.concat_ws("/", "scan_id", "run_id").isin(["/".join(r) for r in runs]))


def run_places(spark: SparkSession, runs: list[tuple[str, str]]) -> DataFrame:
    """(scan_id, run_id, _place): the order in which runs were published."""
    return spark.createDataFrame([(*r, k) for k, r in enumerate(runs)], "scan_id string, run_id string, _place int")


def _not_retired(spark: SparkSession, path: str, rows: DataFrame, runs: list[tuple[str, str]]) -> DataFrame:
    """``rows`` without those of archives that a run published later has retired.

    Retired archives are those a refresh found changed or deleted: few against the
    catalogue, so Spark broadcasts them as long as their measured size allows it."""
    if not path_exists(f"{path}/retired", spark):
        return rows
    place, run = run_places(spark, runs), ["scan_id", "run_id"]
    retired = in_runs(read_table(spark, f"{path}/retired", _with_run(RETIRED)), runs)
    last = retired.join(place, run).groupBy("archive_uuid").agg(F.max("_place").alias("_retired"))
    kept = rows.join(place, run).join(last, "archive_uuid", "left").filter(
        F.col("_retired").isNull() | (F.col("_place") >= F.col("_retired")))
    return kept.select(rows.columns)


def visible(spark: SparkSession, path: str, table: str, schema: StructType, runs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows of a table's published runs (``runs``, if the caller has read them already).

    The runs are fixed when the DataFrame is made: a query sees one state of the catalogue."""
    runs = published_runs(spark, path) if runs is None else runs
    rows = in_runs(read_table(spark, f"{path}/{table}", _with_run(schema)), runs)
    return _not_retired(spark, path, rows, runs) if runs and table in ("archives", "entries", "archive_totals") else rows


def totals_of(entries: DataFrame) -> DataFrame:
    """``ARCHIVE_TOTALS`` rows of entries."""
    return entries.groupBy("archive_uuid").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("file_size").cast("long").alias("total_size"),
        F.min("file_size").alias("min_size"), F.max("file_size").alias("max_size"),
        F.sum("compressed_size").cast("long").alias("compressed"))


def _stored_totals(spark: SparkSession, path: str, runs: list[tuple[str, str]], entries: DataFrame) -> DataFrame:
    """The totals that runs have stored, and those of the entries of runs that have none."""
    rows = visible(spark, path, "archive_totals", ARCHIVE_TOTALS, runs).select(ARCHIVE_TOTALS.fieldNames())
    stored = partitions_of(f"{path}/archive_totals", spark)
    bare = [r for r in runs if r not in stored]
    return rows.unionByName(totals_of(in_runs(entries, bare))) if bare else rows


@dataclass
class Catalog:
    archives: DataFrame
    entries: DataFrame
    totals: DataFrame | None = None   # ``ARCHIVE_TOTALS`` rows of the entries, if they are stored

    def per_archive(self) -> DataFrame:
        """One ``ARCHIVE_TOTALS`` row for each archive that has entries."""
        if self.totals is None:
            return totals_of(self.entries)
        return self.totals.groupBy("archive_uuid").agg(
            F.sum("entries").alias("entries"), F.sum("total_size").cast("long").alias("total_size"),
            F.min("min_size").alias("min_size"), F.max("max_size").alias("max_size"),
            F.sum("compressed").cast("long").alias("compressed"))

    @staticmethod
    def read(spark: SparkSession, path: str, resolve: bool = False, refresh: bool = False) -> "Catalog":
        """Open a stored catalogue.

        The sink registers each archive path once (first scan wins), so by
        default a reader only applies the visibility rule of the manifest.

        ``resolve`` handles catalogues assembled by other means (copied
        partitions, concurrent writers): a path registered by several scans
        is resolved to the first (lowest ``scan_seq``), or the latest with
        ``refresh``, by a map-side-combined ``min``/``max`` over the
        ``(scan_seq, scan_id)`` key, and entries follow the chosen scan.
        """
        runs = published_runs(spark, path)
        arch = visible(spark, path, "archives", ARCHIVES, runs)
        ent = visible(spark, path, "entries", ENTRIES, runs)
        if not (resolve or refresh):
            return Catalog(arch, ent, _stored_totals(spark, path, runs, ent))
        pick = F.max if refresh else F.min
        winner = (arch.groupBy("archive_path")
                  .agg(pick(F.struct("scan_seq", "scan_id")).alias("w"))
                  .select("archive_path", F.col("w.scan_seq").alias("scan_seq"), F.col("w.scan_id").alias("scan_id")))
        chosen = arch.join(winner, ["archive_path", "scan_seq", "scan_id"], "left_semi")
        kept = ent.join(chosen.select("archive_uuid", "scan_id"), ["archive_uuid", "scan_id"], "left_semi")
        return Catalog(chosen, kept)
