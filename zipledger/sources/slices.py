"""Work on entry contents, in slices of archives that hold about the same bytes.

One task opens an archive once for each of its slices; a slice is a run of entries of
one archive whose compressed sizes add up to ``SLICE_BYTES`` (a larger entry is a slice
by itself). The number of tasks follows from the bytes to read.

An entry whose place the catalogue knows (``PLACE``) is read from there: the stream seeks
to its local header, and the archive's directory, which grows with all its entries, is not
read again for every slice. Where the place is unknown, or the header found there is not
that of the entry (the archive has changed since the scan), the directory decides.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zipledger.operators.ranking import running
from zipledger.session import materialize
from zipledger.sources.fs import open_binary
from zipledger.sources.reader import task_count

SLICE_BYTES = 256 << 20
#: What an entry costs beyond its bytes.
ENTRY_BYTES = 4 << 10
#: Where and how an entry is stored, as the scan has found it.
PLACE = ["path_in_archive", "file_size", "compressed_size", "crc32", "header_offset", "compress_type"]
#: Entry numbers added up in one window.
BUCKET = 1 << 16

# ---- fixed values of the ZIP format: the local file header ------------------
LOCAL_HEADER = struct.Struct("<4s5H3L2H")   # signature, version, flags, method, time, date, crc, sizes, lengths
SIGNATURE = b"PK\x03\x04"
ENCRYPTED, DESCRIPTOR, UTF8_NAME = 0x1, 0x8, 0x800
# -------------------------------------------------------------------------------


def with_place(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``rows`` and those of ``PLACE`` that it has."""
    return rows.select(*columns, *(c for c in PLACE if c in rows.columns and c not in columns))


def sliced(rows: DataFrame, *order: str, size: str = "compressed_size") -> DataFrame:
    """``rows`` (``archive_path``, ``entry_ordinal``) dealt to tasks slice by slice.

    Without a ``size`` column every entry counts as ``ENTRY_BYTES``."""
    cost = F.lit(ENTRY_BYTES)
    if size in rows.columns:
        cost = cost + F.coalesce(F.col(size), F.lit(0))
    names = rows.columns
    # written once: the rows come from reading directories, or from joins
    rows = materialize(rows.withColumn("_cost", cost), "slices")
    total = rows.agg(F.sum("_cost")).first()[0] or 0
    n = task_count(rows.sparkSession, total, SLICE_BYTES)
    rows = rows.withColumn("_bucket", F.coalesce(F.floor(F.col("entry_ordinal") / BUCKET), F.lit(-1)))
    return (running(rows, "archive_path", "_bucket", ["entry_ordinal"], F.col("_cost"))
            .withColumn("_slice", F.floor(F.col("running") / SLICE_BYTES))
            .repartition(n, "archive_path", "_slice").select(*names)
            .sortWithinPartitions("archive_path", *(order or ("entry_ordinal",))))


class Opened:
    """The archive read last; the next entries are likely to be of the same one."""

    def __init__(self):
        self.path = self.stream = self.zip = self.error = None
        self.infos: list[zipfile.ZipInfo] = []

    def _at(self, path: str) -> None:
        if path != self.path:
            self.close()
            self.path, self.error = path, None
            try:
                self.stream = open_binary(path)
            except Exception as e:
                self.error = e
        if self.error is not None:
            raise self.error

    def entry(self, path: str, ordinal: int) -> zipfile.ZipInfo:
        """The directory's entry; raises what opening the archive raised."""
        self._at(path)
        if self.zip is None:
            try:
                self.zip = zipfile.ZipFile(self.stream)
                self.infos = self.zip.infolist()
            except Exception as e:
                self.error = e
                raise
        return self.infos[ordinal]

    def read(self, row: dict):
        """A stream of the entry's bytes, checked against its checksum at their end."""
        found = self.placed(row)
        if found is None:
            info = self.entry(row["archive_path"], int(row["entry_ordinal"]))
            found = self.zip.open(info)
        return found

    def placed(self, row: dict) -> zipfile.ZipExtFile | None:
        """The entry's bytes from the place that the catalogue knows; None if it is not there."""
        self._at(row["archive_path"])
        if any(pd.isna(row.get(name)) for name in PLACE):
            return None
        info = zipfile.ZipInfo(row["path_in_archive"])
        info.compress_type, info.CRC = int(row["compress_type"]), int(row["crc32"])
        info.file_size, info.compress_size = int(row["file_size"]), int(row["compressed_size"])
        self.stream.seek(int(row["header_offset"]))
        header = self.stream.read(LOCAL_HEADER.size)
        if len(header) < LOCAL_HEADER.size:
            return None
        signature, _, flags, method, _, _, crc, _, _, name_bytes, extra_bytes = LOCAL_HEADER.unpack(header)
        name = self.stream.read(name_bytes).decode("utf-8" if flags & UTF8_NAME else "cp437", "replace")
        if (signature != SIGNATURE or method != info.compress_type or flags & ENCRYPTED
                or not flags & DESCRIPTOR and crc != info.CRC   # else the checksum follows the bytes
                or name.split("\0")[0] != row["path_in_archive"]):
            return None
        self.stream.seek(extra_bytes, 1)
        return zipfile.ZipExtFile(self.stream, "r", info)

    def close(self) -> None:
        for handle in (self.zip, self.stream):
            if handle is not None:
                handle.close()
        self.stream = self.zip = None
        self.infos = []


def each_entry(make: Callable[[Opened, dict], tuple], columns: list[str], flush_rows: int = 1000,
               flush_bytes: int = 16 << 20):
    """A ``mapInPandas`` function: ``make`` turns the open archive and a row into a result row.

    Results are handed on after ``flush_rows``, or as soon as their strings take ``flush_bytes``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, out, held = Opened(), [], 0
        try:
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    out.append(make(opened, row))
                    held += sum(len(x) for x in out[-1] if isinstance(x, str))
                    if len(out) >= flush_rows or held >= flush_bytes:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)
        finally:
            opened.close()
    return run


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"
