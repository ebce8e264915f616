"""``spark.read.format("archive_entries")``: the entries of all archives below some folders.

    register_source(spark)
    spark.read.format("archive_entries").load("/mnt/c").where("file_size > 1048576")
    spark.readStream.format("archive_entries").load("/mnt/c")
    CREATE TEMPORARY VIEW e USING archive_entries OPTIONS (path '/mnt/c')

The source plans its partitions: folders are opened breadth first until there are enough of
them, and a partition takes a share of the archives below some folder, told by the checksum
of their paths, so that one flat folder is spread as well. Only folder names are handled
while planning; archives are listed and read in the tasks. Comparisons of sizes, paths and
of the number of an entry are pushed into the source: an archive whose path does not pass is
not opened, an entry that does not pass makes no row.

As a stream, the offset is a time: a batch has the archives that were put or changed in
place after one offset and up to the next (the time of the inode's last change, which
renaming into place sets and which cannot be set back; on remote file systems the
modification time). Offsets stay ``lagSeconds`` (2) behind the clock, so no file can still
get a time that a batch has passed. A replayed batch has the same files, but for those
changed since, which come with their new contents in a later batch: no state of a file is
lost or comes twice. An archive that has changed comes again as a whole.

Options: ``path`` (several, separated by commas), ``partitions`` (64), ``lagSeconds``. A bad
archive is one row with ``error_class`` and ``error_message`` and nulls; a folder that
cannot be read has no archives; an entry without a date has a null time.
"""

from __future__ import annotations

import os
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains,
                                    StringEndsWith, StringStartsWith)

from zipledger.session import ship_package
from zipledger.sources.fs import local_path, open_binary
from zipledger.sources.reader import _mtime

SCHEMA = ("archive_path string, archive_size long, archive_mtime double, entry_ordinal int, path_in_archive string, file_size long, "
          "compressed_size long, entry_mtime timestamp_ntz, crc32 long, header_offset long, compress_type int, error_class string, error_message string")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Columns that filters are pushed on.
PUSHED = ("archive_path", "archive_size", "entry_ordinal", "path_in_archive", "file_size", "compressed_size")
TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}


@dataclass
class Share(InputPartition):
    """The archives of some folder, or of all below it, that fall to one of ``shares``; changed in (since, until]."""
    folder: str
    deep: bool
    share: int
    shares: int
    since: int = 0
    until: int = 1 << 62


def _folder(path: str) -> list[tuple[str, bool, int, float, int]]:
    """(path, is a folder, bytes, modification time, time of the last change) of a folder's children; links to folders are not followed."""
    found = []
    local = local_path(path)
    try:
        if local is not None:
            with os.scandir(local) as children:
                for child in children:
                    if child.is_dir(follow_symlinks=False):
                        found.append((child.path, True, 0, 0.0, 0))
                    elif child.name.lower().endswith(".zip") and child.is_file():
                        stat = child.stat()
                        found.append((child.path, False, stat.st_size, float(stat.st_mtime), stat.st_ctime_ns))
        else:
            from pyarrow import fs
            files, inner = fs.FileSystem.from_uri(path)
            head = path[:len(path) - len(inner)]
            for info in files.get_file_info(fs.FileSelector(inner)):
                if info.type == fs.FileType.Directory:
                    found.append((head + info.path, True, 0, 0.0, 0))
                elif info.base_name.lower().endswith(".zip"):
                    found.append((head + info.path, False, info.size, (info.mtime_ns or 0) / 1e9, info.mtime_ns or 0))
    except OSError:
        return []
    return sorted(found)


def _archives(share: Share) -> Iterator[tuple[str, int, float]]:
    todo = [share.folder]
    while todo:
        for path, is_folder, size, mtime, changed in _folder(todo.pop()):
            if is_folder:
                if share.deep:
                    todo.append(path)
            elif share.since < changed <= share.until and zlib.crc32(path.encode()) % share.shares == share.share:
                yield path, size, mtime


def _passes(tests: list[tuple[int, object, object]], row: tuple, known: tuple[int, ...]) -> bool:
    """Whether the values at the ``known`` columns pass; null passes no comparison."""
    return all(row[at] is not None and test(row[at], value) for at, test, value in tests if at in known)


def _rows(share: Share, tests: list[tuple[int, object, object]]) -> Iterator[tuple]:
    every = tuple(range(len(COLUMNS)))
    for about in _archives(share):
        path = about[0]
        row: tuple = (*about, *(None,) * 10)
        if not _passes(tests, row, (0, 1, 2)):
            continue
        try:
            with open_binary(path) as stream, zipfile.ZipFile(stream) as archive:
                for i, info in enumerate(archive.infolist()):
                    row = (*about, i, info.filename, info.file_size, info.compress_size, _mtime(info), info.CRC,
                           info.header_offset, info.compress_type, None, None)
                    if _passes(tests, row, every):
                        yield row
        except Exception as e:
            row = (*about, *(None,) * 8, type(e).__name__, str(e))
            if _passes(tests, row, every):
                yield row


def _plan(options: dict) -> list[Share]:
    """Shares of the folders below the options' paths, at least ``partitions`` of them."""
    wanted = int(options.get("partitions", 64))
    closed = [p.strip().rstrip("/") or "/" for p in options["path"].split(",") if p.strip()]
    opened: list[str] = []
    while closed and len(closed) < wanted:
        below = [c[0] for path in closed for c in _folder(path) if c[1]]
        opened += closed
        closed = below
    folders = [(p, False) for p in opened] + [(p, True) for p in closed]
    shares = max(1, -(-wanted // max(len(folders), 1)))
    return [Share(path, deep, k, shares) for path, deep in folders for k in range(shares)]


class BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in TESTS and name in PUSHED:
                self.tests.append((COLUMNS.index(name), TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Share]:
        return _plan(self.options)

    def read(self, partition: Share) -> Iterator[tuple]:
        return _rows(partition, self.tests)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(float(self.options.get("lagSeconds", 2)) * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        if end["until"] <= start["until"]:
            return []
        return [Share(s.folder, s.deep, s.share, s.shares, start["until"], end["until"]) for s in _plan(self.options)]

    def read(self, partition: Share) -> Iterator[tuple]:
        return _rows(partition, [])

    def commit(self, end: dict) -> None:
        """Offsets are times; there is nothing to release."""


class ArchiveEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register_source(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed into it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveEntries)
