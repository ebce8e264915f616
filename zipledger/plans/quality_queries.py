"""Registered queries of the documented (tier B) and roadmap (tier C) jobs."""

from __future__ import annotations

import datetime as _dt
import uuid as _uuid

from pyspark.sql import functions as F

from zipledger.functions.ids import archive_uuid
from zipledger.functions.paths import VIDEO_EXTENSIONS, is_target
from zipledger.operators import analytics as A
from zipledger.operators import extract as X
from zipledger.operators import quality as Q
from zipledger.operators import search as S
from zipledger.operators.stats import list_archives
from zipledger.plans.extract_queries import _V, fixture_catalog, full_catalog
from zipledger.plans.oracle_sql import ENT0, ext_of, with_catalog
from zipledger.plans.registry import SEARCH_COLS, UUID, VIDEO_EXT_SQL, cat, register
from zipledger.plans.scan_queries import _ALL_ARCHIVES, _catalog_path, fixture, rel
from zipledger.plans.scan import list_roots
from zipledger.session import shared_dir
from zipledger.schemas import SCAN_METRICS, SCAN_PROGRESS
from zipledger.sources.catalog import Catalog, visible
from zipledger.sources.derived import entry_rows, read_documents
from zipledger.sources.packer import entry_datetime_sql
from zipledger.sources.reader import read_central_directories
from zipledger.streaming.watch import watch


def _with_v(select_sql: str, extra: str = "") -> str:
    return f"WITH {ENT0.strip()},{_V}{(',' + extra.strip()) if extra else ''}\n{select_sql.strip()}"


def _with_all(select_sql: str) -> str:
    """Like ``_with_v``, with ``v`` holding every entry, whatever its type."""
    return (f"WITH {ENT0.strip()},\nv AS (SELECT *, lang || '/' || file_name AS path_in_archive FROM ent0)\n"
            f"{select_sql.strip()}")


_DRIVE = "upper(split_part(archive_path, '/', 3)) || ':'"
_BAD = "regexp_extract(archive_path, '^(.*/takeout-)', 1) || source || '-index.zip'"
_FOLD = "translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# ---- B-1 / C-3: duplicates ----------------------------------------------------------
@register("dup_by_hash", with_catalog("""
SELECT file_size, file_hash, COUNT(*) AS copies, COUNT(DISTINCT archive_uuid) AS archives
FROM ent GROUP BY file_size, file_hash HAVING COUNT(*) > 1"""))
def q_dup_by_hash(spark, sf_dir):
    return Q.duplicate_groups(cat(spark, sf_dir).entries)


@register("dup_by_content", _with_all("""
SELECT file_size, sha256(d.text) AS file_hash, COUNT(*) AS copies, COUNT(DISTINCT v.archive_path) AS archives
FROM v JOIN documents d USING (doc_id) GROUP BY file_size, sha256(d.text) HAVING COUNT(*) > 1"""))
def q_dup_by_content(spark, sf_dir):
    # scanned catalogues store no hashes: entries of equal size and checksum are hashed on read
    _, c = full_catalog(spark, sf_dir)
    return Q.duplicates_by_content(c)


@register("same_file_across_archives", with_catalog("""
SELECT file_size, file_hash, COUNT(DISTINCT archive_uuid) AS archives, COUNT(*) AS copies
FROM ent GROUP BY file_size, file_hash HAVING COUNT(DISTINCT archive_uuid) > 1"""))
def q_same_file(spark, sf_dir):
    return A.same_file_across_archives(cat(spark, sf_dir).entries)


# ---- B-2 / C-12: exports read back ---------------------------------------------------------
_SEARCH_SQL = with_catalog(f"""
SELECT {SEARCH_COLS} FROM ja
WHERE {_FOLD} LIKE '%00%' AND file_size >= 1000 AND file_size <= 200000
  AND ({_FOLD} LIKE '%.mp4' OR {_FOLD} LIKE '%.mov')""")


def _exported(spark, sf_dir, fmt: str):
    res = S.search(cat(spark, sf_dir), "00", min_size=1000, max_size=200000, file_types=["mp4", "mov"])
    out = shared_dir(spark, "zipledger-export", f"{fmt}-{_uuid.uuid4().hex}")
    w = res.write.mode("overwrite")
    if fmt == "xml":
        w.format("xml").option("rowTag", "row").save(out)
        return spark.read.schema(res.schema).format("xml").option("rowTag", "row").load(out)
    if fmt == "csv":
        w.option("header", True).csv(out)
        return spark.read.schema(res.schema).option("header", True).csv(out)
    w.json(out)
    return spark.read.schema(res.schema).json(out)


@register("export_csv", _SEARCH_SQL)
def q_export_csv(spark, sf_dir):
    return _exported(spark, sf_dir, "csv")


@register("export_json", _SEARCH_SQL)
def q_export_json(spark, sf_dir):
    return _exported(spark, sf_dir, "json")


@register("export_xml", _SEARCH_SQL)
def q_export_xml(spark, sf_dir):
    return _exported(spark, sf_dir, "xml")


# ---- B-3: validation -----------------------------------------------------------------------
@register("validate_orphans", with_catalog("""
SELECT 'lost-' || archive_uuid AS archive_uuid, file_name, path_in_archive FROM ja WHERE drive = 'E:'"""))
def q_validate_orphans(spark, sf_dir):
    # planted: the entries of one drive a second time, under archives that are not there
    c = cat(spark, sf_dir)
    moved = c.entries.join(c.archives.filter(F.col("drive") == "E:").select("archive_uuid"), "archive_uuid")
    moved = moved.withColumn("archive_uuid", F.concat(F.lit("lost-"), "archive_uuid"))
    broken = Catalog(c.archives, c.entries.unionByName(moved))
    return Q.orphan_entries(broken).select("archive_uuid", "file_name", "path_in_archive")


@register("validate_empty_archives", with_catalog("""
SELECT 'empty-' || archive_uuid AS archive_uuid, '/empty' || archive_path AS archive_path FROM arch"""))
def q_validate_empty(spark, sf_dir):
    # planted: every archive a second time without its entries
    c = cat(spark, sf_dir)
    bare = c.archives.withColumn("archive_uuid", F.concat(F.lit("empty-"), "archive_uuid")).withColumn(
        "archive_path", F.concat(F.lit("/empty"), "archive_path"))
    return Q.empty_archives(Catalog(c.archives.unionByName(bare), c.entries)).select("archive_uuid", "archive_path")


@register("validate_duplicate_paths", with_catalog("""
SELECT archive_path, CAST(2 AS BIGINT) AS copies FROM arch WHERE drive = 'C:'"""))
def q_validate_dup_paths(spark, sf_dir):
    a = cat(spark, sf_dir).archives
    return Q.duplicate_paths(a.unionByName(a.filter(F.col("drive") == "C:")))


@register("validate_missing", _with_v(f"""
SELECT DISTINCT archive_path AS rel_path FROM v WHERE {_DRIVE} = 'E:'"""))
def q_validate_missing(spark, sf_dir):
    base, c = fixture_catalog(spark, sf_dir)
    _, roots = fixture(spark, sf_dir)
    listing, _ = list_roots(spark, roots.filter(F.col("drive") != "E:"), mode="takeout")
    return Q.missing_archives(c, listing).select(rel(base).alias("rel_path"))


@register("validate_size_drift", _with_v(f"""
SELECT DISTINCT archive_path AS rel_path, CAST(7 AS BIGINT) AS grown FROM v WHERE {_DRIVE} = 'C:'"""))
def q_validate_size_drift(spark, sf_dir):
    # the archives of one drive have grown by seven bytes since the scan
    base, c = fixture_catalog(spark, sf_dir)
    _, roots = fixture(spark, sf_dir)
    listing, _ = list_roots(spark, roots, mode="takeout")
    grown = listing.withColumn("file_size", F.when(F.col("drive") == "C:", F.col("file_size") + 7)
                               .otherwise(F.col("file_size")))
    return Q.size_drift(c, grown).select(rel(base).alias("rel_path"),
                                         (F.col("size_now") - F.col("file_size")).alias("grown"))


# ---- B-4 / B-5 / B-6: preview, resume, metrics ------------------------------------------------
@register("scan_preview", _with_v(f"""
SELECT archive_path AS rel_path, {_DRIVE} AS drive, COUNT(*) AS entries FROM v GROUP BY archive_path"""))
def q_scan_preview(spark, sf_dir):
    # dry run: listing and reading, nothing registered
    from zipledger.plans.scan import scan
    base, roots = fixture(spark, sf_dir)
    res = scan(spark, roots, mode="takeout", all_files=False, scan_ts=_dt.datetime(2024, 1, 2))
    return (res.entries.groupBy("archive_path", "drive").agg(F.count(F.lit(1)).alias("entries"))
            .select(rel(base).alias("rel_path"), "drive", "entries"))


@register("scan_resume", f"""
WITH {ENT0.strip()},{_ALL_ARCHIVES} SELECT rel_path FROM all_arch WHERE drive = 'E:'""")
def q_scan_resume(spark, sf_dir):
    # after a full scan only archives that have changed since are left to do: here those of one drive
    base, _ = full_catalog(spark, sf_dir)
    _, roots = fixture(spark, sf_dir)
    listing, _ = list_roots(spark, roots, mode="takeout")
    edited = listing.withColumn("file_size", F.when(F.col("drive") == "E:", F.col("file_size") + 1)
                                .otherwise(F.col("file_size")))
    progress = visible(spark, _catalog_path(spark, sf_dir) + "-all", "scan_progress", SCAN_PROGRESS)
    return Q.scan_resume(edited, progress).select(rel(base).alias("rel_path"))


@register("scan_progress", f"""
WITH {ENT0.strip()},{_ALL_ARCHIVES}
SELECT rel_path, CASE WHEN archive_name LIKE '%-index.zip' THEN 'error' ELSE 'done' END AS status FROM all_arch""")
def q_scan_progress(spark, sf_dir):
    base, _ = full_catalog(spark, sf_dir)
    progress = visible(spark, _catalog_path(spark, sf_dir) + "-all", "scan_progress", SCAN_PROGRESS)
    return progress.select(rel(base).alias("rel_path"), "status")


@register("scan_metrics", _with_all(f"""
SELECT COUNT(DISTINCT {_DRIVE}) AS total_drives, COUNT(DISTINCT archive_path) AS total_zip_files,
       COUNT(*) AS total_video_files, CAST(SUM(file_size) AS BIGINT) AS total_size_bytes,
       TRUE AS has_duration FROM v"""))
def q_scan_metrics(spark, sf_dir):
    # the row the scan job wrote
    full_catalog(spark, sf_dir)
    row = visible(spark, _catalog_path(spark, sf_dir) + "-all", "scan_metrics", SCAN_METRICS)
    return row.select("total_drives", "total_zip_files", "total_video_files", "total_size_bytes",
                      (F.col("scan_duration_seconds") >= 0).alias("has_duration"))


# ---- C-4 / C-5: date filter, archive statistics, timeline -------------------------------------
_MTIME = entry_datetime_sql("doc_id")


@register("filter_by_date", _with_all(f"""
SELECT archive_path AS rel_path, path_in_archive, {_MTIME} AS entry_mtime FROM v
WHERE {_MTIME} >= TIMESTAMP '2021-01-01' AND {_MTIME} < TIMESTAMP '2022-01-01'"""))
def q_filter_by_date(spark, sf_dir):
    base, c = full_catalog(spark, sf_dir)
    e = c.entries.join(c.archives.select("archive_uuid", "archive_path"), "archive_uuid")
    f = A.filter_dates(e, _dt.datetime(2021, 1, 1), _dt.datetime(2022, 1, 1))
    return f.select(rel(base).alias("rel_path"), "path_in_archive", "entry_mtime")


def _squeezed(spark, sf_dir):
    """The derived catalogue with a compressed size that SQL can tell: the text without its spaces."""
    rows = entry_rows(read_documents(spark, sf_dir), with_text=True).select(
        archive_uuid("archive_path").alias("archive_uuid"), "entry_ordinal",
        F.octet_length(F.translate("text", " ", "")).cast("long").alias("compressed_size"))
    c = cat(spark, sf_dir)
    return Catalog(c.archives, c.entries.drop("compressed_size").join(rows, ["archive_uuid", "entry_ordinal"]))


_SQUEEZED = "sq AS (SELECT ent.*, CAST(strlen(replace(d.text, ' ', '')) AS BIGINT) AS compressed_size FROM ent JOIN documents d USING (doc_id))"


@register("archive_stats", with_catalog("""
SELECT a.archive_uuid, a.archive_name, COUNT(*) AS entries, CAST(SUM(e.file_size) AS BIGINT) AS total_size,
       MIN(e.file_size) AS min_size, MAX(e.file_size) AS max_size, AVG(e.file_size) AS avg_size,
       CASE WHEN SUM(e.file_size) > 0 THEN CAST(SUM(e.compressed_size) AS BIGINT) / CAST(SUM(e.file_size) AS BIGINT) END
         AS compression_ratio
FROM arch a JOIN sq e USING (archive_uuid) GROUP BY a.archive_uuid, a.archive_name""", _SQUEEZED))
def q_archive_stats(spark, sf_dir):
    s = A.archive_stats(_squeezed(spark, sf_dir))
    return s.select("archive_uuid", "archive_name", "entries", "total_size", "min_size", "max_size",
                    "avg_size", "compression_ratio")


@register("archive_ratio", _with_all("""
SELECT archive_path AS rel_path, COUNT(*) AS entries, CAST(SUM(file_size) AS BIGINT) AS total_size, TRUE AS within
FROM v GROUP BY archive_path"""))
def q_archive_ratio(spark, sf_dir):
    # deflated prose takes between a twentieth and all of its size
    base, c = full_catalog(spark, sf_dir)
    s = A.archive_stats(c)
    return s.select(rel(base).alias("rel_path"), "entries", "total_size",
                    F.col("compression_ratio").between(0.05, 1.05).alias("within"))


@register("filter_by_ratio", with_catalog("""
SELECT archive_uuid, path_in_archive FROM sq WHERE file_size > 0 AND compressed_size / file_size <= 0.85""", _SQUEEZED))
def q_filter_by_ratio(spark, sf_dir):
    # about a word in six ends after five letters, so the bound parts the entries
    return A.filter_ratio(_squeezed(spark, sf_dir).entries, 0.85).select("archive_uuid", "path_in_archive")


@register("timeline", _with_all(f"""
SELECT date_trunc('month', {_MTIME}) AS period, COUNT(*) AS entries, CAST(SUM(file_size) AS BIGINT) AS bytes
FROM v GROUP BY 1"""))
def q_timeline(spark, sf_dir):
    _, c = full_catalog(spark, sf_dir)
    return A.timeline(c.entries, "month")


# ---- C-6: compare two versions of one archive ----------------------------------------------
@register("compare_archives", with_catalog(f"""
SELECT path_in_archive, file_size AS left_size,
       CASE file_size % 5 WHEN 0 THEN NULL WHEN 1 THEN file_size + 1 ELSE file_size END AS right_size,
       CASE file_size % 5 WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' WHEN 2 THEN 'changed' ELSE 'same' END AS status
FROM ent WHERE archive_uuid = '{UUID}'
UNION ALL
SELECT 'new/' || path_in_archive, NULL, file_size, 'added' FROM ent
WHERE archive_uuid = '{UUID}' AND file_size % 5 = 3"""))
def q_compare_archives(spark, sf_dir):
    # an archive and a later version of it: entries gone, grown, rewritten at their size, and new ones
    left = cat(spark, sf_dir).entries.filter(F.col("archive_uuid") == UUID)
    kind = F.pmod("file_size", F.lit(5))
    right = (left.filter(kind != 0)
             .withColumn("crc32", F.when(kind == 2, F.col("crc32").bitwiseXOR(F.lit(1))).otherwise(F.col("crc32")))
             .withColumn("file_size", F.col("file_size") + F.when(kind == 1, 1).otherwise(0)))
    new = left.filter(kind == 3).withColumn("path_in_archive", F.concat(F.lit("new/"), "path_in_archive"))
    return A.compare(left, right.unionByName(new))


# ---- C-11: categories ------------------------------------------------------------------------
CATEGORIES = {**{e: "video" for e in VIDEO_EXTENSIONS}, ".jpg": "image", ".txt": "document"}


@register("categories", with_catalog(f"""
SELECT CASE WHEN {ext_of('path_in_archive')} IN ({VIDEO_EXT_SQL}) THEN 'video'
            WHEN {ext_of('path_in_archive')} = '.jpg' THEN 'image'
            WHEN {ext_of('path_in_archive')} = '.txt' THEN 'document' ELSE 'other' END AS category,
       COUNT(*) AS entries, CAST(SUM(file_size) AS BIGINT) AS bytes
FROM ent GROUP BY 1"""))
def q_categories(spark, sf_dir):
    e = A.categorize(spark, cat(spark, sf_dir).entries, CATEGORIES)
    return e.groupBy("category").agg(F.count(F.lit(1)).alias("entries"), F.sum("file_size").cast("long").alias("bytes"))


# ---- C-8: integrity check --------------------------------------------------------------------
@register("integrity_check", f"""
WITH {ENT0.strip()}
SELECT archive_path AS rel_path, 'ok' AS status, COUNT(*) AS checked, CAST(NULL AS INTEGER) AS first_bad
FROM ent0 GROUP BY archive_path
UNION ALL
SELECT DISTINCT {_BAD}, 'error', CAST(0 AS BIGINT), CAST(NULL AS INTEGER) FROM ent0""")
def q_integrity_check(spark, sf_dir):
    base, roots = fixture(spark, sf_dir)
    listing, _ = list_roots(spark, roots, mode="takeout")
    raw = read_central_directories(listing)
    return A.integrity_check(raw).select(rel(base).alias("rel_path"), "status", "checked", "first_bad")


# ---- C-9: extraction preview (plan and space needed, nothing written) -------------------------
@register("extract_plan", _with_v(f"""
SELECT row_number() OVER (ORDER BY file_size DESC, archive_path, doc_id) AS plan_pos,
       archive_path AS rel_path, path_in_archive, file_name AS out_name, file_size
FROM v WHERE {_FOLD} LIKE '%img%'"""))
def q_extract_plan(spark, sf_dir):
    base, c = fixture_catalog(spark, sf_dir)
    m = S.matched(c, S.name_predicate("img"))
    p = X.plan(m, S.size_desc(), shared_dir(spark, "zipledger-extract", "preview"))
    return p.select("plan_pos", rel(base).alias("rel_path"), "path_in_archive", "out_name", "file_size")


@register("extract_space", _with_v(f"""
SELECT COUNT(*) AS files, CAST(SUM(file_size) AS BIGINT) AS bytes_needed FROM v WHERE {_FOLD} LIKE '%img%'"""))
def q_extract_space(spark, sf_dir):
    _, c = fixture_catalog(spark, sf_dir)
    m = S.matched(c, S.name_predicate("img"))
    return m.agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").cast("long").alias("bytes_needed"))


# ---- C-11: extraction by rules ------------------------------------------------------------
@register("extract_by_rules", _with_all(f"""
SELECT CASE WHEN {ext_of('path_in_archive')} IN ({VIDEO_EXT_SQL}) THEN 'video'
            WHEN file_size < 2000 THEN 'small' ELSE 'other' END || '/' || file_name AS out_name,
       path_in_archive, 'ok' AS status, file_size AS bytes_written
FROM v"""))
def q_extract_by_rules(spark, sf_dir):
    _, c = full_catalog(spark, sf_dir)
    rules = [(is_target("path_in_archive"), "video"), (F.col("file_size") < 2000, "small")]
    out = shared_dir(spark, "zipledger-extract", _uuid.uuid4().hex)
    res = X.extract_by_rules(S.matched(c, F.lit(True)), S.size_desc(), out, rules)
    return res.select(F.substring(F.col("output_path"), len(out) + 2, 1 << 30).alias("out_name"),
                      "path_in_archive", "status", "bytes_written")


# ---- C-1: streaming registration of new archives ------------------------------------------
@register("stream_scan", _with_v(f"""
SELECT split_part(archive_path, '/', -1) AS archive_name, {_DRIVE} AS drive, COUNT(*) AS file_count,
       archive_path AS rel_path
FROM v GROUP BY archive_path"""))
def q_stream_scan(spark, sf_dir):
    base, _ = fixture(spark, sf_dir)
    run_id = _uuid.uuid4().hex
    catalog_path = shared_dir(spark, "zipledger-stream", run_id, "catalog")
    ckpt = shared_dir(spark, "zipledger-stream", run_id, "checkpoint")
    drive_of = lambda c: F.concat(F.upper(F.regexp_extract(c, r"/mnt/([a-z])/GoogleTakeout/", 1)), F.lit(":"))
    q = watch(spark, base + "/mnt/*/GoogleTakeout", catalog_path, ckpt, all_files=False, drive_of=drive_of,
              max_files_per_trigger=32, scan_ts=_dt.datetime(2024, 1, 3))
    q.awaitTermination()
    c = Catalog.read(spark, catalog_path)
    return list_archives(c).select("archive_name", "drive", "file_count", rel(base).alias("rel_path"))


# ---- C-2: search inside text entries ---------------------------------------------------------
@register("search_text", _with_all("""
SELECT v.archive_path AS rel_path, v.path_in_archive, v.file_name, v.file_size
FROM v JOIN documents d USING (doc_id) WHERE regexp_matches(d.text, '[Ll]icen[cs]e')"""))
def q_search_text(spark, sf_dir):
    # whole texts of all entries, read from the scanned archives
    base, c = full_catalog(spark, sf_dir)
    hits = A.search_text(c, "[Ll]icen[cs]e", extensions=None)
    return hits.select(rel(base).alias("rel_path"), "path_in_archive", "file_name", "file_size")
