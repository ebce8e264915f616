"""Pack the ``documents`` table into real ZIP archives (test and bench fixture).

The derived catalogue (:mod:`zipledger.sources.derived`) says which archive
and path each document gets; this job writes those archives below a root
folder so the listing, reader and extractor run on real files. Rows are
hash-partitioned by archive and sorted by (archive, doc_id); each task streams
its rows into one ZIP at a time, so memory stays at one batch and the work of
one task is bounded by ``PART_ROWS`` documents per archive part. Each archive is written under a temporary
name and renamed when complete, so a retried task never leaves a torn file.

Besides the real parts, every source gets one ``takeout-<source>-index.zip``
that is not a ZIP at all (it holds the source name as text), to exercise the
bad-archive path.
"""

from __future__ import annotations

import os
import uuid as _uuid
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from zipledger.session import shared_dir
from zipledger.sources.derived import archive_path_col, entry_rows, read_documents
from zipledger.sources.fs import mark, path_exists, size_of, version_of
from zipledger.sources.reader import task_count

#: Bytes of the stored table that one task packs, about.
PACK_BYTES = 64 << 20

#: Of deflation: many small texts, packed as fast as that goes.
LEVEL = 1

PACK_RESULT = StructType([
    StructField("archive_path", StringType(), False),
    StructField("entries", LongType(), False),
])


def entry_datetime(doc_id: int) -> tuple:
    """Modification time stored for a packed entry (a rule on doc_id)."""
    return (2020 + doc_id % 4, doc_id % 12 + 1, doc_id % 28 + 1, doc_id % 24, doc_id % 60, (doc_id % 30) * 2)


def entry_datetime_sql(col: str = "doc_id") -> str:
    """Same rule as :func:`entry_datetime`, as a SQL timestamp expression."""
    return (f"make_timestamp(2020 + {col} % 4, {col} % 12 + 1, {col} % 28 + 1, {col} % 24, "
            f"{col} % 60, ({col} % 30) * 2)")


def _writer(base: str):
    """Texts go from the Arrow batch into the archive as they lie there: a task holds one batch and no copy of it."""
    def write(batches):
        current, zf, tmp, final, n = None, None, None, None, 0

        def close():
            zf.close()
            os.replace(tmp, final)
            return pa.RecordBatch.from_pydict({"archive_path": [current], "entries": [n]})

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("archive_path", "path_in_archive", "doc_id")), batch.column("text"))
            for path, member, doc_id, text in rows:
                if path != current:
                    if zf is not None:
                        yield close()
                    current, n = path, 0
                    final = base + path
                    os.makedirs(os.path.dirname(final), exist_ok=True)
                    tmp = f"{final}.{_uuid.uuid4().hex}.part"
                    zf = zipfile.ZipFile(tmp, "w", compression=zipfile.ZIP_DEFLATED)
                info = zipfile.ZipInfo(member, date_time=entry_datetime(doc_id))
                info.compress_type = zipfile.ZIP_DEFLATED
                zf.writestr(info, memoryview(text.as_buffer()), compresslevel=LEVEL)
                n += 1
            batch = rows = text = None   # gone before the next one comes
        if zf is not None:
            yield close()
    return write


def _bad_writer(base: str):
    def write(batches):
        for pdf in batches:
            for path, source in zip(pdf["bad_path"], pdf["source"]):
                final = base + path
                os.makedirs(os.path.dirname(final), exist_ok=True)
                tmp = f"{final}.{_uuid.uuid4().hex}.part"
                with open(tmp, "w", encoding="utf-8") as fh:
                    fh.write(f"index of {source}\n")
                os.replace(tmp, final)
                yield pd.DataFrame({"archive_path": [path], "entries": [0]})
    return write


def bad_archive_path_col():
    arch = F.col("archive_path")
    return F.concat(F.regexp_extract(arch, r"^(.*/takeout-)", 1), F.col("source"), F.lit("-index.zip"))


def pack_documents(spark: SparkSession, sf_dir: str, base: str | None = None) -> str:
    """Write the fixture archives for ``sf_dir`` (once) and return their root folder.

    Archive ``/mnt/c/GoogleTakeout/x.zip`` of the derived catalogue is written
    to ``<root>/mnt/c/GoogleTakeout/x.zip``.
    """
    if base is None:
        key = os.path.basename(sf_dir.rstrip("/"))
        base = shared_dir(spark, "zipledger-fixtures", f"{key}-{version_of(f'{sf_dir}/documents.parquet', spark)}")
    marker = f"{base}/_PACKED"
    if path_exists(marker, spark):
        return base
    docs = read_documents(spark, sf_dir)
    rows = entry_rows(docs, with_text=True).select("archive_path", "path_in_archive", "doc_id", "text")
    parts = task_count(spark, size_of(f"{sf_dir}/documents.parquet", spark), PACK_BYTES)
    # whole archives per task (a part holds at most PART_ROWS documents)
    (rows.repartition(parts, "archive_path")
     .sortWithinPartitions("archive_path", "doc_id")
     .mapInArrow(_writer(base), PACK_RESULT)
     .write.format("noop").mode("overwrite").save())
    bad = (docs.select("source", archive_path_col().alias("archive_path"))
           .select(bad_archive_path_col().alias("bad_path"), "source").distinct())
    bad.mapInPandas(_bad_writer(base), PACK_RESULT).write.format("noop").mode("overwrite").save()
    mark(marker, spark)
    return base


def _bundle_writer(base: str):
    def write(batches):
        for pdf in batches:
            for path in pdf["archive_path"]:
                part = base + path
                letter = path.split("/")[2]
                final = f"{base}/nested/{letter}/bundle-{os.path.basename(path)}"
                os.makedirs(os.path.dirname(final), exist_ok=True)
                tmp = f"{final}.{_uuid.uuid4().hex}.part"
                with zipfile.ZipFile(tmp, "w") as zf:
                    zf.write(part, arcname=f"parts/{os.path.basename(path)}", compress_type=zipfile.ZIP_STORED)
                os.replace(tmp, final)
                yield pd.DataFrame({"archive_path": [final], "entries": [1]})
    return write


def pack_nested(spark: SparkSession, sf_dir: str) -> str:
    """Bundles holding one packed archive part each: ``<root>/nested/<c|d|e>/bundle-<part>.zip``.

    One bundle per part keeps every bundle bounded (a whole source or drive
    in one bundle would be one hot task).
    """
    base = pack_documents(spark, sf_dir)
    marker = f"{base}/_NESTED"
    if path_exists(marker, spark):
        return base
    parts = (read_documents(spark, sf_dir).select(archive_path_col().alias("archive_path")).distinct())
    n = max(spark.sparkContext.defaultParallelism, 2)
    (parts.repartition(n, "archive_path").mapInPandas(_bundle_writer(base), PACK_RESULT)
     .write.format("noop").mode("overwrite").save())
    mark(marker, spark)
    return base


#: An entry that edited archives get in addition.
ADDED = ("en/IMG_added.MP4", b"added")


def _editor(base: str):
    def edit(batches):
        for pdf in batches:
            for path, kind in zip(pdf["archive_path"], pdf["kind"]):
                final = base + path
                if kind == 2:
                    os.remove(final)
                else:
                    tmp = f"{final}.{_uuid.uuid4().hex}.part"
                    with zipfile.ZipFile(final) as old, zipfile.ZipFile(tmp, "w", compression=zipfile.ZIP_DEFLATED) as new:
                        for i, info in enumerate(old.infolist()):
                            if kind == 0 or i % 2 == 0:
                                new.writestr(info, old.read(info))
                        if kind == 0:
                            new.writestr(*ADDED)
                    os.replace(tmp, final)
                yield pd.DataFrame({"archive_path": [path], "entries": [kind]})
    return edit


def edit_archives(spark: SparkSession, sf_dir: str, base: str) -> None:
    """Change packed archives by the number in their source's name, modulo 4: 0 grow by an entry, 1 keep every
    second entry, 2 are deleted, the others stay. ``base`` is a packing of its own, not the shared one."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)"), F.lit(0))
    rows = (read_documents(spark, sf_dir).select(archive_path_col().alias("archive_path"), (number % 4).alias("kind"))
            .distinct().filter("kind < 3"))
    n = max(spark.sparkContext.defaultParallelism, 2)
    (rows.repartition(n, "archive_path").mapInPandas(_editor(base), PACK_RESULT)
     .write.format("noop").mode("overwrite").save())
