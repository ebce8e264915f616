"""Registered queries over real archives: listing, reading, scan job, sink.

The archives are the ``documents`` rows packed into ZIP files below the
shared folder (:func:`zipledger.sources.packer.pack_documents`); the oracle is
SQL over ``documents`` with the same naming rules. Paths are reported relative
to the fixture root so both sides agree.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid as _uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zipledger.operators.stats import list_archives
from zipledger.plans.oracle_sql import ENT0, ext_of
from zipledger.plans.register import expire
from zipledger.plans.register import register as write_run
from zipledger.plans.registry import VIDEO_EXT_SQL, register
from zipledger.plans.scan import list_roots, scan, scan_and_register
from zipledger.session import shared_dir
from zipledger.sources.catalog import Catalog
from zipledger.sources.datasource import register_source
from zipledger.sources.derived import archive_path_col, read_documents
from zipledger.sources.listing import filter_roots
from zipledger.sources.packer import ADDED, edit_archives, entry_datetime_sql, pack_documents

SCAN_TS = _dt.datetime(2024, 1, 2)


def fixture(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """(root folder of the packed archives, roots DataFrame ``(root, drive)``)."""
    base = pack_documents(spark, sf_dir)
    letters = (read_documents(spark, sf_dir)
               .select(F.regexp_extract(archive_path_col(), r"^/mnt/([a-z])/", 1).alias("l")).distinct())
    roots = letters.select(F.concat(F.lit(base + "/mnt/"), F.col("l")).alias("root"),
                           F.concat(F.upper("l"), F.lit(":")).alias("drive"))
    return base, roots


def rel(base: str, c: str = "archive_path"):
    return F.substring(F.col(c), len(base) + 1, 1 << 30)


_DRIVE = "upper(split_part(archive_path, '/', 3)) || ':'"
_BAD = "regexp_extract(archive_path, '^(.*/takeout-)', 1) || source || '-index.zip'"

_ALL_ARCHIVES = f"""
all_arch AS (
  SELECT DISTINCT archive_path AS rel_path, split_part(archive_path, '/', -1) AS archive_name, {_DRIVE} AS drive
  FROM ent0
  UNION
  SELECT DISTINCT {_BAD}, split_part({_BAD}, '/', -1), {_DRIVE} FROM ent0
)"""


def _entries_sql(video_only: bool) -> str:
    where = f"WHERE {ext_of('path_in_archive')} IN ({VIDEO_EXT_SQL})" if video_only else ""
    return f"""
WITH {ENT0.strip()},
e AS (
  SELECT *, lang || '/' || file_name AS path_in_archive,
         CAST(row_number() OVER (PARTITION BY archive_path ORDER BY doc_id) - 1 AS INTEGER) AS entry_ordinal2
  FROM ent0
)
SELECT {_DRIVE} AS drive, split_part(archive_path, '/', -1) AS archive_name, archive_path AS rel_path,
       file_name, file_size, path_in_archive, entry_ordinal2 AS entry_ordinal,
       {entry_datetime_sql('doc_id')} AS entry_mtime
FROM e {where}"""


def _scan_entries(spark, sf_dir, all_files: bool):
    base, roots = fixture(spark, sf_dir)
    res = scan(spark, roots, mode="takeout", all_files=all_files, scan_ts=SCAN_TS)
    return res.entries.select("drive", F.substring_index("archive_path", "/", -1).alias("archive_name"),
                              rel(base).alias("rel_path"), "file_name", "file_size", "path_in_archive",
                              "entry_ordinal", "entry_mtime")


@register("scan_entries", _entries_sql(False))
def q_scan_entries(spark, sf_dir):
    return _scan_entries(spark, sf_dir, True)


@register("scan_entries_video", _entries_sql(True))
def q_scan_entries_video(spark, sf_dir):
    return _scan_entries(spark, sf_dir, False)


def _source_sql(where: str) -> str:
    return f"""
WITH {ENT0.strip()},
e AS (SELECT archive_path AS rel_path, lang || '/' || file_name AS path_in_archive, file_size,
             CAST(row_number() OVER (PARTITION BY archive_path ORDER BY doc_id) - 1 AS INTEGER) AS entry_ordinal,
             CAST(NULL AS VARCHAR) AS error_class FROM ent0
      UNION ALL SELECT DISTINCT {_BAD}, NULL, NULL, NULL, 'BadZipFile' FROM ent0)
SELECT * FROM e {where}"""


def _from_source(spark, sf_dir):
    base, _ = fixture(spark, sf_dir)
    register_source(spark)
    rows = spark.read.format("archive_entries").load(base + "/mnt")
    return rows.select(rel(base).alias("rel_path"), "path_in_archive", "file_size", "entry_ordinal", "error_class")


@register("source_entries", _source_sql(""))
def q_source_entries(spark, sf_dir):
    # the reader format: every archive below a folder, bad ones as error rows
    return _from_source(spark, sf_dir)


@register("source_entries_filtered", _source_sql("WHERE file_size >= 2000 AND path_in_archive LIKE 'en/%'"))
def q_source_entries_filtered(spark, sf_dir):
    # both comparisons are pushed into the source
    return _from_source(spark, sf_dir).where("file_size >= 2000 AND path_in_archive LIKE 'en/%'")


@register("scan_errors", f"""
WITH {ENT0.strip()}
SELECT DISTINCT {_BAD} AS rel_path, {_DRIVE} AS drive, 'BadZipFile' AS error_class,
       'File is not a zip file' AS error_message
FROM ent0""")
def q_scan_errors(spark, sf_dir):
    base, roots = fixture(spark, sf_dir)
    res = scan(spark, roots, mode="takeout", all_files=True, scan_ts=SCAN_TS)
    return res.errors.select(rel(base).alias("rel_path"), "drive", "error_class", "error_message")


@register("list_archives", f"WITH {ENT0.strip()},{_ALL_ARCHIVES} SELECT rel_path, archive_name, drive FROM all_arch")
def q_list_archives(spark, sf_dir):
    base, roots = fixture(spark, sf_dir)
    listing, _ = list_roots(spark, roots, mode="all")
    return listing.select(rel(base).alias("rel_path"), "archive_name", "drive")


@register("list_takeout", f"WITH {ENT0.strip()},{_ALL_ARCHIVES} SELECT rel_path, archive_name, drive FROM all_arch")
def q_list_takeout(spark, sf_dir):
    base, roots = fixture(spark, sf_dir)
    listing, _ = list_roots(spark, roots, mode="takeout")
    return listing.select(rel(base).alias("rel_path"), "archive_name", "drive")


@register("list_archives_binaryfile",
          f"WITH {ENT0.strip()},{_ALL_ARCHIVES} SELECT rel_path, archive_name, drive FROM all_arch")
def q_list_archives_binaryfile(spark, sf_dir):
    # the object-store listing path: Spark's binaryFile source over every drive folder
    from zipledger.sources.listing import list_binaryfile
    base, _ = fixture(spark, sf_dir)
    drive_of = lambda c: F.concat(F.upper(F.regexp_extract(c, r"/mnt/([a-z])/", 1)), F.lit(":"))
    listing = list_binaryfile(spark, base + "/mnt/*", base=base, drive_of=drive_of)
    return listing.select(rel(base).alias("rel_path"), "archive_name", "drive")


@register("archive_metadata", f"""
WITH {ENT0.strip()},{_ALL_ARCHIVES}
SELECT rel_path, archive_name, TRUE AS has_size, TRUE AS has_mtime FROM all_arch""")
def q_archive_metadata(spark, sf_dir):
    base, roots = fixture(spark, sf_dir)
    listing, _ = list_roots(spark, roots, mode="takeout")
    return listing.select(rel(base).alias("rel_path"), "archive_name",
                          (F.coalesce("file_size", F.lit(0)) > 0).alias("has_size"),
                          F.col("last_modified").isNotNull().alias("has_mtime"))


@register("roots_filtered", f"""
WITH {ENT0.strip()}
SELECT DISTINCT '/mnt/' || split_part(archive_path, '/', 3) AS rel_root, {_DRIVE} AS drive
FROM ent0 WHERE split_part(archive_path, '/', 3) <> 'e'""")
def q_roots_filtered(spark, sf_dir):
    base, roots = fixture(spark, sf_dir)
    excluded = roots.filter(F.col("drive") == "E:").select("root")
    return filter_roots(roots, excluded).select(rel(base, "root").alias("rel_root"), "drive")


def _catalog_path(spark, sf_dir) -> str:
    # named after the fixture, whose folder changes with the documents table
    return shared_dir(spark, "zipledger-catalogs") + "/" + os.path.basename(pack_documents(spark, sf_dir))


def _run_scan_job(spark, sf_dir, path=None):
    """The scan job over the fixture, into a catalogue of its own unless ``path`` is given."""
    base, roots = fixture(spark, sf_dir)
    path = path or shared_dir(spark, "zipledger-catalogs", f"job-{_uuid.uuid4().hex}")
    res = scan_and_register(spark, roots, path, "fixture-scan", mode="takeout", all_files=False,
                            scan_ts=SCAN_TS, scan_seq=1)
    return base, path, res


_VIDEO_ENT = f"""
v AS (
  SELECT archive_path, {_DRIVE} AS drive FROM ent0
  WHERE {ext_of("lang || '/' || file_name")} IN ({VIDEO_EXT_SQL})
),
per_drive AS (
  SELECT drive, COUNT(DISTINCT archive_path) AS zip_count, COUNT(*) AS video_count FROM v GROUP BY drive
),
drives AS (SELECT DISTINCT {_DRIVE} AS drive FROM ent0)"""

_JOB_ROLLUP = f"""
WITH {ENT0.strip()},{_VIDEO_ENT}
SELECT d.drive, CAST(coalesce(p.zip_count, 0) AS BIGINT) AS zip_count,
       CAST(coalesce(p.video_count, 0) AS BIGINT) AS video_count,
       CAST(NULL AS VARCHAR) AS error, TRUE AS success
FROM drives d LEFT JOIN per_drive p USING (drive)"""


@register("scan_job", _JOB_ROLLUP)
def q_scan_job(spark, sf_dir):
    _, _, res = _run_scan_job(spark, sf_dir)
    return res.rollup


@register("scan_job_totals", f"""
SELECT CAST(SUM(zip_count) AS BIGINT) AS total_zips, CAST(SUM(video_count) AS BIGINT) AS total_videos,
       COUNT(*) AS drives, CAST(COUNT(*) AS BIGINT) AS drives_ok
FROM ({_JOB_ROLLUP}) x""")
def q_scan_job_totals(spark, sf_dir):
    _, _, res = _run_scan_job(spark, sf_dir)
    return res.totals()


@register("register", f"""
WITH {ENT0.strip()},{_VIDEO_ENT}
SELECT split_part(archive_path, '/', -1) AS archive_name, drive, COUNT(*) AS file_count,
       archive_path AS rel_path
FROM v GROUP BY archive_path, drive""")
def q_register(spark, sf_dir):
    # what the sink wrote for the fixture scan, read back through the catalogue reader
    from zipledger.plans.extract_queries import fixture_catalog
    base, cat = fixture_catalog(spark, sf_dir)
    return list_archives(cat).select("archive_name", "drive", "file_count", rel(base).alias("rel_path"))


_KIND = "coalesce(TRY_CAST(NULLIF(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER), 0) % 4"


@register("scan_refresh", f"""
WITH {ENT0.strip()},
e AS (SELECT archive_path, lang || '/' || file_name AS path_in_archive, file_size, {_KIND} AS kind,
             row_number() OVER (PARTITION BY archive_path ORDER BY doc_id) - 1 AS i FROM ent0)
SELECT archive_path AS rel_path, path_in_archive, file_size,
       CAST(CASE WHEN kind = 1 THEN i // 2 ELSE i END AS INTEGER) AS entry_ordinal,
       CASE WHEN kind = 3 THEN 'first' ELSE 'second' END AS scan_id
FROM e WHERE kind <> 2 AND (kind <> 1 OR i % 2 = 0)
UNION ALL
SELECT archive_path, '{ADDED[0]}', CAST({len(ADDED[1])} AS BIGINT), CAST(count(*) AS INTEGER), 'second'
FROM e WHERE kind = 0 GROUP BY archive_path""")
def q_scan_refresh(spark, sf_dir):
    # archives that grow, shrink and vanish between two scans; unchanged ones are not read again
    base = shared_dir(spark, "zipledger-fixtures", f"refresh-{_uuid.uuid4().hex}")
    pack_documents(spark, sf_dir, base)
    _, roots = fixture(spark, sf_dir)
    name = F.regexp_extract("root", "/mnt/[a-z]$", 0)
    roots = roots.select(F.concat(F.lit(base), name).alias("root"), "drive")
    path = shared_dir(spark, "zipledger-catalogs", f"refresh-{_uuid.uuid4().hex}")
    scan_and_register(spark, roots, path, "first", all_files=True, scan_ts=SCAN_TS, refresh=True)
    edit_archives(spark, sf_dir, base)
    scan_and_register(spark, roots, path, "second", all_files=True, scan_ts=SCAN_TS, refresh=True)
    c = Catalog.read(spark, path)
    return c.entries.join(c.archives.select("archive_uuid", "archive_path"), "archive_uuid").select(
        rel(base).alias("rel_path"), "path_in_archive", "file_size", "entry_ordinal", "scan_id")


@register("register_rerun", f"""
WITH {ENT0.strip()},{_VIDEO_ENT}
SELECT split_part(archive_path, '/', -1) AS archive_name, drive, COUNT(*) AS file_count, CAST(1 AS BIGINT) AS runs
FROM v GROUP BY archive_path, drive""")
def q_register_rerun(spark, sf_dir):
    # one scan registered four times; what is left of the older runs after they expire
    from zipledger.plans.extract_queries import fixture_catalog
    _, cat = fixture_catalog(spark, sf_dir)
    path = shared_dir(spark, "zipledger-catalogs", f"rerun-{_uuid.uuid4().hex}")
    for _ in range(4):
        write_run(path, cat.archives, cat.entries, "again")
    expire(spark, path, _dt.timedelta(0))
    runs = spark.read.parquet(f"{path}/entries").join(
        spark.read.parquet(f"{path}/archives").select("archive_uuid", "archive_name").distinct(), "archive_uuid")
    runs = runs.groupBy("archive_name").agg(F.count_distinct("run_id").alias("runs"))
    return list_archives(Catalog.read(spark, path)).select("archive_name", "drive", "file_count").join(runs, "archive_name")


@register("scan_nested", f"""
WITH {ENT0.strip()}
SELECT '/nested/' || split_part(archive_path, '/', 3) || '/bundle-' || split_part(archive_path, '/', -1)
         || '!/parts/' || split_part(archive_path, '/', -1) AS rel_path,
       {_DRIVE} AS drive, file_name, file_size, lang || '/' || file_name AS path_in_archive
FROM ent0""")
def q_scan_nested(spark, sf_dir):
    # bundles each holding one packed part: the inner archives are read through the outer ones
    from zipledger.sources.packer import pack_nested
    base = pack_nested(spark, sf_dir)
    letters = (read_documents(spark, sf_dir)
               .select(F.regexp_extract(archive_path_col(), r"^/mnt/([a-z])/", 1).alias("l")).distinct())
    roots = letters.select(F.concat(F.lit(base + "/nested/"), F.col("l")).alias("root"),
                           F.concat(F.upper("l"), F.lit(":")).alias("drive"))
    res = scan(spark, roots, mode="all", all_files=True, nested=True, scan_ts=SCAN_TS)
    inner = res.entries.filter(F.col("archive_path").contains("!/"))
    return inner.select(rel(base).alias("rel_path"), "drive", "file_name", "file_size", "path_in_archive")
