"""Explode archives into entry rows on the executors.

Each task opens its archives by path and reads only the central directory
(``zipfile`` seeks to the end of the file; entry bytes are never read), in
directory order with duplicates kept, and yields bounded pandas batches.
An archive that cannot be read yields one error row instead of entries, and
the scan goes on. The split of those rows into entries and errors, the
target-file predicate and the directory-entry rule are Spark expressions
applied afterwards.
"""

from __future__ import annotations

import datetime as _dt
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from zipledger.functions.ids import archive_uuid
from zipledger.functions.paths import basename, is_directory_entry, is_target
from zipledger.schemas import RAW_ENTRIES
from zipledger.sources.fs import open_binary

_RAW_COLS = [f.name for f in RAW_ENTRIES.fields]
BATCH_ROWS = 2000
#: Central directories one task reads, about.
ARCHIVES_PER_TASK = 500


def _mtime(info: zipfile.ZipInfo):
    try:
        return _dt.datetime(*info.date_time)
    except (TypeError, ValueError):
        return None


def _read_directories(batch_rows: int, more: tuple[str, ...] = ()):
    """``more`` are listing columns that every row gets; an archive without entries then makes a row of nulls."""
    columns = _RAW_COLS + list(more)

    def run(batches):
        out = []
        for pdf in batches:
            for path, drive, *rest in zip(*(pdf[c] for c in ("archive_path", "drive", *more))):
                try:
                    with open_binary(path) as fh, zipfile.ZipFile(fh) as zf:
                        infos = zf.infolist()
                        if more and not infos:
                            out.append((path, drive, *[None] * 10, *rest))
                        for i, info in enumerate(infos):
                            out.append((path, drive, i, info.filename, int(info.file_size), int(info.compress_size),
                                        _mtime(info), int(info.CRC), info.header_offset, info.compress_type, None, None,
                                        *rest))
                            if len(out) >= batch_rows:
                                yield pd.DataFrame(out, columns=columns)
                                out = []
                except Exception as e:  # bad archive: record and continue
                    out.append((path, drive, *[None] * 8, type(e).__name__, str(e), *rest))
                if len(out) >= batch_rows:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)
    return run


def task_count(spark, amount: int, each: int) -> int:
    """Tasks for ``amount`` of work: ``each`` per task, and at least two per core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-int(amount) // int(each)), 2)


def read_central_directories(listing: DataFrame, batch_rows: int = BATCH_ROWS,
                             tasks: int | None = None) -> DataFrame:
    """``RAW_ENTRIES`` rows for every archive of ``listing`` (archive_path, drive).

    Archives are hash-spread over ``tasks`` partitions (default: as many as the
    number of archives asks for). The number is explicit so AQE does not
    coalesce the small listing rows into a single reading task.
    """
    n = tasks or task_count(listing.sparkSession, listing.count(), ARCHIVES_PER_TASK)
    return (listing.select("archive_path", "drive")
            .repartition(n, "archive_path")
            .mapInPandas(_read_directories(batch_rows), RAW_ENTRIES))


def read_listed(listing: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``RAW_ENTRIES`` rows with ``archive_size`` and ``archive_modified`` (microseconds) of their archive.

    Every archive of ``listing`` (archive_path, drive and those two) has a row, so one table holds all that a scan
    of it found. Archives are read where the listing has them: Spark deals files to tasks by size and number."""
    more = ["archive_size", "archive_modified"]
    schema = StructType([*RAW_ENTRIES.fields, *(StructField(c, LongType(), True) for c in more)])
    return listing.select("archive_path", "drive", *more).mapInPandas(_read_directories(batch_rows, tuple(more)), schema)


def is_inner_archive() -> Column:
    """Reader rows that are themselves archives to look into."""
    return (F.col("error_class").isNull() & ~is_directory_entry("path_in_archive")
            & F.lower("path_in_archive").endswith(".zip"))


def inner_archives(raw: DataFrame) -> DataFrame:
    """Listing rows (``LISTING``) of the archives stored inside the archives of ``raw``.

    The virtual path is ``<outer>!/<member>``; a member whose name an earlier
    inner archive has already is named with its ordinal.
    """
    inner = raw.filter(is_inner_archive())
    first = inner.groupBy("archive_path", "path_in_archive").agg(F.min("entry_ordinal").alias("_first"))
    into = F.when(F.col("entry_ordinal") == F.col("_first"), F.lit("!/")).otherwise(
        F.concat(F.lit("!"), F.col("entry_ordinal").cast("string"), F.lit("/")))
    return inner.join(first, ["archive_path", "path_in_archive"]).select(
        F.lit(None).cast("string").alias("root"), "drive",
        F.concat("archive_path", into, "path_in_archive").alias("archive_path"),
        basename("path_in_archive").alias("archive_name"), "file_size",
        F.col("entry_mtime").alias("last_modified"))


def split_entries(raw: DataFrame, all_files: bool = False, created_at=None) -> tuple[DataFrame, DataFrame]:
    """(entries, errors): catalogue entry rows for target files, and error rows."""
    ok = raw.filter(F.col("error_class").isNull())
    ts = created_at if created_at is not None else F.current_timestamp()
    entries = (ok.filter(~is_directory_entry("path_in_archive") & is_target("path_in_archive", all_files))
               .select(archive_uuid("archive_path").alias("archive_uuid"),
                       "archive_path", "drive",
                       basename("path_in_archive").alias("file_name"),
                       "file_size", "path_in_archive", "entry_ordinal",
                       F.lit(None).cast("string").alias("file_hash"),
                       ts.alias("created_at"), "compressed_size", "entry_mtime", "crc32",
                       "header_offset", "compress_type"))
    errors = raw.filter(F.col("error_class").isNotNull()).select(
        "archive_path", "drive", "error_class", "error_message")
    return entries, errors
