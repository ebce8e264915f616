"""Named catalogue queries: a Spark plan and, where SQL can say it, a DuckDB oracle.

Every query reads the driver tables (``documents``, ``pages``) or data Spark
derives from them, over the whole tables. Parameters are fixed per key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zipledger.functions import paths as P
from zipledger.functions import text as T
from zipledger.functions.ids import archive_uuid_py
from zipledger.operators import search as S
from zipledger.operators import stats as ST
from zipledger.plans.oracle_sql import ext_of, fold, with_catalog
from zipledger.sources.derived import stored_derived_catalog


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def cat(spark: SparkSession, sf_dir: str):
    """The catalogue derived from ``documents``, registered once and read."""
    return stored_derived_catalog(spark, sf_dir)


# ---- fixed query parameters --------------------------------------------------
UUID_PATH = "/mnt/c/GoogleTakeout/takeout-src3-001.zip"
UUID = archive_uuid_py(UUID_PATH)
VIDEO_EXT_SQL = ", ".join(f"'{e}'" for e in P.VIDEO_EXTENSIONS)
# -------------------------------------------------------------------------------

SEARCH_COLS = "drive, archive_name, archive_path, file_name, file_size, path_in_archive"


def _like(pat: str) -> str:
    return f"{fold('file_name')} LIKE '%{pat.lower()}%'"


# ---- A-18 / A-11 / A-13 / A-14: search ---------------------------------------
@register("search_combined", with_catalog(f"""
SELECT {SEARCH_COLS} FROM ja
WHERE {_like('00')} AND file_size >= 1000 AND file_size <= 200000
  AND ({fold('file_name')} LIKE '%.mp4' OR {fold('file_name')} LIKE '%.mov')"""))
def q_search_combined(spark, sf_dir):
    return S.search(cat(spark, sf_dir), "00", min_size=1000, max_size=200000, file_types=["mp4", "mov"])


@register("search_like", with_catalog(f"SELECT {SEARCH_COLS} FROM ja WHERE {_like('img_0001')}"))
def q_search_like(spark, sf_dir):
    # '_' stays a wildcard, matching is ASCII case-insensitive
    return S.search(cat(spark, sf_dir), "IMG_0001")


@register("search_regex", with_catalog(
    f"SELECT {SEARCH_COLS} FROM ja WHERE regexp_matches(file_name, '[0-9]{{2}}7\\.(mov|jpg)$')"))
def q_search_regex(spark, sf_dir):
    return S.search(cat(spark, sf_dir), r"[0-9]{2}7\.(mov|jpg)$", regex=True)


@register("search_regex_i", with_catalog(
    f"SELECT {SEARCH_COLS} FROM ja WHERE regexp_matches(file_name, '(?i)^img_00[0-4]')"))
def q_search_regex_i(spark, sf_dir):
    return S.search(cat(spark, sf_dir), "^img_00[0-4]", regex=True, ignore_case=True)


@register("search_size_range", with_catalog(
    f"SELECT {SEARCH_COLS} FROM ja WHERE file_size >= 5000 AND file_size <= 20000"))
def q_search_size_range(spark, sf_dir):
    return S.search(cat(spark, sf_dir), "", min_size=5000, max_size=20000)


@register("search_min_zero", with_catalog(f"SELECT {SEARCH_COLS} FROM ja WHERE file_size >= 0 AND {_like('-00')}"))
def q_search_min_zero(spark, sf_dir):
    # 0 is a valid bound, not "unset"
    return S.search(cat(spark, sf_dir), "-00", min_size=0)


@register("search_types", with_catalog(
    f"SELECT {SEARCH_COLS} FROM ja WHERE {fold('file_name')} LIKE '%.txt' OR {fold('file_name')} LIKE '%.jpg'"))
def q_search_types(spark, sf_dir):
    return S.search(cat(spark, sf_dir), "", file_types=["txt", "JPG"])


@register("search_like_cs", with_catalog(f"SELECT {SEARCH_COLS} FROM ja WHERE file_name LIKE '%IMG_00%'"))
def q_search_like_cs(spark, sf_dir):
    return S.search(cat(spark, sf_dir), "IMG_00", case_sensitive=True)


@register("topk_largest", with_catalog(
    f"SELECT {SEARCH_COLS} FROM ja WHERE {_like('.mp4')} "
    "ORDER BY file_size DESC, archive_path, entry_ordinal LIMIT 10"))
def q_topk_largest(spark, sf_dir):
    return S.search(cat(spark, sf_dir), ".mp4", limit=10)


# ---- A-7 / A-9 / A-10 / A-38: path rules over real messy paths (pages.url) ----
@register("target_filter", with_catalog(f"""
SELECT archive_uuid, file_name, {ext_of('path_in_archive')} AS extension,
       {ext_of('path_in_archive')} IN ({VIDEO_EXT_SQL}) AS is_target
FROM ent"""))
def q_target_filter(spark, sf_dir):
    c = cat(spark, sf_dir).entries
    return c.select("archive_uuid", "file_name", P.extension("path_in_archive").alias("extension"),
                    P.is_target("path_in_archive").alias("is_target"))


@register("basename", f"""
SELECT page_id, split_part(url, '/', -1) AS base, {ext_of('url')} AS extension,
       {ext_of('url')} IN ({VIDEO_EXT_SQL}) AS is_target
FROM pages""")
def q_basename(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", P.basename("url").alias("base"), P.extension("url").alias("extension"),
                        P.is_target("url").alias("is_target"))


_POSIX_LABEL = """CASE WHEN length(regexp_extract({p}, '^(/*)', 1)) = 2 THEN '//'
     WHEN len(list_filter(string_split({p}, '/'), lambda x: x <> '' AND x <> '.')) > 0
       THEN list_filter(string_split({p}, '/'), lambda x: x <> '' AND x <> '.')[1]
     ELSE '/' END"""


def _wsl_label(p: str) -> str:
    parts = (f"CASE WHEN length(regexp_extract({p}, '^(/*)', 1)) > 0 THEN "
             f"list_prepend('/', list_filter(string_split({p}, '/'), lambda x: x <> '' AND x <> '.')) "
             f"ELSE list_filter(string_split({p}, '/'), lambda x: x <> '' AND x <> '.') END")
    return (f"CASE WHEN len({parts}) >= 3 AND ({parts})[2] = 'mnt' AND regexp_matches(({parts})[3], '^\\p{{L}}\\z') "
            f"THEN upper(({parts})[3]) || ':' ELSE {_POSIX_LABEL.format(p=p)} END")


_LABEL_SRC = """
paths AS (
  SELECT 'page' AS kind, CAST(page_id AS VARCHAR) AS id,
         regexp_replace(url, '^[a-z]+://', '/') AS p FROM pages
  UNION ALL
  SELECT 'url', CAST(page_id AS VARCHAR), url FROM pages
  UNION ALL
  SELECT 'archive', archive_uuid, archive_path FROM arch
  UNION ALL
  SELECT 'relative', archive_uuid, substr(archive_path, 2) FROM arch
)"""


@register("drive_label", with_catalog(f"""
SELECT kind, id, p,
       {_POSIX_LABEL.format(p='p')} AS posix_label,
       {_wsl_label('p')} AS wsl_label,
       split_part(p, ':', 1) || ':' AS windows_label
FROM paths""", _LABEL_SRC))
def q_drive_label(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arch = cat(spark, sf_dir).archives
    src = (pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("id"),
                        F.regexp_replace("url", "^[a-z]+://", "/").alias("p"))
           .unionByName(pages.select(F.lit("url").alias("kind"), F.col("page_id").cast("string").alias("id"),
                                     F.col("url").alias("p")))
           .unionByName(arch.select(F.lit("archive").alias("kind"), F.col("archive_uuid").alias("id"),
                                    F.col("archive_path").alias("p")))
           .unionByName(arch.select(F.lit("relative").alias("kind"), F.col("archive_uuid").alias("id"),
                                    F.expr("substring(archive_path, 2)").alias("p"))))
    return src.select("kind", "id", "p", P.drive_label("p", "posix").alias("posix_label"),
                      P.drive_label("p", "wsl").alias("wsl_label"),
                      P.drive_label("p", "windows").alias("windows_label"))


_NORM_STEP = ("lambda acc, x: CASE WHEN x = '' OR x = '.' THEN acc WHEN x = '..' THEN "
              "CASE WHEN acc <> '' AND split_part(acc, '/', -1) <> '..' THEN regexp_replace(acc, '/?[^/]*\\z', '') "
              "WHEN {init} <> '' THEN acc ELSE CASE WHEN acc = '' THEN x ELSE acc || '/' || x END END "
              "ELSE CASE WHEN acc = '' THEN x ELSE acc || '/' || x END END")


def _normpath_sql(p: str) -> str:
    init = (f"(CASE WHEN length(regexp_extract({p}, '^(/*)', 1)) = 2 THEN '//' "
            f"WHEN length(regexp_extract({p}, '^(/*)', 1)) > 0 THEN '/' ELSE '' END)")
    s = f"({init} || list_reduce(string_split({p}, '/'), {_NORM_STEP.format(init=init)}, ''))"
    return f"CASE WHEN {s} = '' THEN '.' ELSE {s} END"


_MESSY = """
messy AS (
  SELECT page_id,
         regexp_replace(url, '^[a-z]+://', '//') || '/./../' || CAST(page_id % 7 AS VARCHAR) || '//x/..' AS p
  FROM pages
  UNION ALL
  SELECT page_id, 'c:\\Users\\' || CAST(page_id AS VARCHAR) || '\\out' FROM pages
  UNION ALL
  SELECT page_id, '../' || split_part(url, '/', -1) || '/../../y/.' FROM pages
)"""


@register("resolve_path", f"""
WITH {_MESSY.strip()}
SELECT page_id, p, {_normpath_sql('p')} AS posix_out,
       CASE WHEN substr(p, 1, 3) IN ('c:\\', 'C:\\') THEN '/mnt/c/' || replace(substr(p, 4), '\\', '/')
            ELSE {_normpath_sql('p')} END AS wsl_out
FROM messy""")
def q_resolve_path(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    messy = (pages.select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", "//"), F.lit("/./../"),
                                              (F.col("page_id") % 7).cast("string"), F.lit("//x/..")).alias("p"))
             .unionByName(pages.select("page_id", F.concat(F.lit("c:\\Users\\"), F.col("page_id").cast("string"),
                                                           F.lit("\\out")).alias("p")))
             .unionByName(pages.select("page_id", F.concat(F.lit("../"), P.basename("url"),
                                                           F.lit("/../../y/.")).alias("p"))))
    return messy.select("page_id", "p", P.resolve_output_path("p", wsl=False).alias("posix_out"),
                        P.resolve_output_path("p", wsl=True).alias("wsl_out"))


# ---- A-15 / A-16 / A-17: units, report projections, shortening ----------------
@register("size_mb", with_catalog("""
SELECT archive_uuid, entry_ordinal, file_size / 1048576.0 AS size_mb FROM ent"""))
def q_size_mb(spark, sf_dir):
    e = cat(spark, sf_dir).entries
    return e.select("archive_uuid", "entry_ordinal", T.size_mb("file_size").alias("size_mb"))


@register("report_search", with_catalog(f"""
SELECT drive, substr(archive_name, 1, 29) AS archive_short, substr(file_name, 1, 39) AS name_short,
       round(file_size / 1048576.0, 1) AS size_mb
FROM ja WHERE {_like('vid-')}"""))
def q_report_search(spark, sf_dir):
    return S.report_search(S.search(cat(spark, sf_dir), "vid-"))


@register("report_archives", with_catalog("""
SELECT substr(a.archive_name, 1, 39) AS name_short, a.drive,
       format('{:,}', coalesce(c.n, 0)) AS files, a.archive_uuid
FROM arch a LEFT JOIN (SELECT archive_uuid, COUNT(*) AS n FROM ent GROUP BY archive_uuid) c USING (archive_uuid)"""))
def q_report_archives(spark, sf_dir):
    la = ST.list_archives(cat(spark, sf_dir))
    return la.select(T.clip("archive_name", 39).alias("name_short"), "drive",
                     T.thousands("file_count").alias("files"), "archive_uuid")


@register("shorten", with_catalog("""
SELECT archive_uuid, entry_ordinal,
  CASE WHEN length(archive_name) > 35 THEN substr(archive_name, 1, 32) || '...' ELSE archive_name END AS zip_short,
  CASE WHEN length(path_in_archive) > 25 THEN substr(path_in_archive, 1, 22) || '...' ELSE path_in_archive END AS path_short,
  CASE WHEN length(archive_path) > 50 THEN substr(archive_path, 1, 50) || '...' ELSE archive_path END AS long_short
FROM ja"""))
def q_shorten(spark, sf_dir):
    c = cat(spark, sf_dir)
    j = S.matched(c, F.lit(True))
    return j.select("archive_uuid", "entry_ordinal", T.shorten("archive_name", 35, 32).alias("zip_short"),
                    T.shorten("path_in_archive", 25, 22).alias("path_short"),
                    T.shorten("archive_path", 50, 50).alias("long_short"))


# ---- A-19 .. A-21: listing and lookups -------------------------------------------
@register("list_entries", with_catalog("SELECT file_name, archive_name, file_size, drive FROM ja"))
def q_list_entries(spark, sf_dir):
    return S.list_entries(cat(spark, sf_dir))


@register("list_entries_limit", with_catalog(
    "SELECT file_name, archive_name, file_size, drive FROM ja ORDER BY file_name, archive_path, entry_ordinal LIMIT 25"))
def q_list_entries_limit(spark, sf_dir):
    return S.list_entries(cat(spark, sf_dir), limit=25)


@register("lookup_by_name", with_catalog(
    f"SELECT archive_path, path_in_archive, file_name, file_size FROM ja WHERE {_like('vid-0001')}"))
def q_lookup_by_name(spark, sf_dir):
    return S.lookup_by_name(cat(spark, sf_dir), "vid-0001")


@register("entries_by_uuid", with_catalog(
    f"SELECT archive_path, path_in_archive, file_name, file_size, archive_uuid FROM ja WHERE archive_uuid = '{UUID}'"))
def q_entries_by_uuid(spark, sf_dir):
    return S.entries_by_uuid(cat(spark, sf_dir), UUID)


@register("entries_by_uuid_filter", with_catalog(
    f"SELECT archive_path, path_in_archive, file_name, file_size, archive_uuid FROM ja "
    f"WHERE archive_uuid = '{UUID}' AND {_like('.mov')}"))
def q_entries_by_uuid_filter(spark, sf_dir):
    return S.entries_by_uuid(cat(spark, sf_dir), UUID, ".MOV")


# ---- A-32: numbered choice ---------------------------------------------------------
@register("pick_nth", with_catalog(f"""
SELECT * FROM (
  SELECT archive_path, path_in_archive, file_name, file_size,
         row_number() OVER (ORDER BY file_size DESC, archive_path, entry_ordinal) AS choice
  FROM ja WHERE {_like('vid-00')}) WHERE choice = 3"""))
def q_pick_nth(spark, sf_dir):
    m = S.matched(cat(spark, sf_dir), P.like_contains("file_name", "vid-00"))
    return S.pick(m, S.size_desc(), 3).select("archive_path", "path_in_archive", "file_name", "file_size", "choice")


@register("pick_all", with_catalog(f"""
SELECT archive_path, path_in_archive, file_name, file_size,
       row_number() OVER (ORDER BY file_size DESC, archive_path, entry_ordinal) AS choice
FROM ja WHERE {_like('vid-')}"""))
def q_pick_all(spark, sf_dir):
    m = S.matched(cat(spark, sf_dir), P.like_contains("file_name", "vid-"))
    return S.pick(m, S.size_desc(), "all").select("archive_path", "path_in_archive", "file_name", "file_size", "choice")


@register("pick_all_by_uuid", with_catalog(f"""
SELECT archive_path, path_in_archive, file_name, file_size,
       row_number() OVER (ORDER BY file_size DESC, archive_path, entry_ordinal) AS choice
FROM ja WHERE archive_uuid = '{UUID}' AND {_like('vid-0')}"""))
def q_pick_all_by_uuid(spark, sf_dir):
    m = S.matched(cat(spark, sf_dir), (F.col("archive_uuid") == UUID) & P.like_contains("file_name", "vid-0"))
    return S.pick(m, S.size_desc(), "all").select(
        "archive_path", "path_in_archive", "file_name", "file_size", "choice")


# ---- A-22, A-25, A-26: statistics ----------------------------------------------------
_SUMMARY_SQL = """
SELECT (SELECT COUNT(DISTINCT drive) FROM arch {af}) AS drives,
       (SELECT COUNT(*) FROM arch {af}) AS zip_files,
       (SELECT COUNT(*) FROM ent {ef}) AS video_files,
       (SELECT CAST(coalesce(SUM(file_size), 0) AS BIGINT) FROM ent {ef}) AS total_size,
       (SELECT coalesce(SUM(file_size), 0) FROM ent {ef}) / 1073741824.0 AS total_size_gb"""


@register("summary", with_catalog(_SUMMARY_SQL.format(af="", ef="")))
def q_summary(spark, sf_dir):
    return ST.summary(cat(spark, sf_dir))


@register("summary_empty", with_catalog(_SUMMARY_SQL.format(af="WHERE drive = 'Z:'", ef="WHERE file_size < 0")))
def q_summary_empty(spark, sf_dir):
    c = cat(spark, sf_dir)
    c = type(c)(c.archives.filter(F.col("drive") == "Z:"), c.entries.filter(F.col("file_size") < 0))
    return ST.summary(c)


@register("archive_info", with_catalog(f"""
SELECT archive_path, archive_name, drive,
       (SELECT COUNT(*) FROM ent e WHERE e.archive_uuid = a.archive_uuid) AS file_count
FROM arch a WHERE archive_uuid = '{UUID}'"""))
def q_archive_info(spark, sf_dir):
    return ST.archive_info(cat(spark, sf_dir), UUID)


@register("archive_info_missing", with_catalog("""
SELECT archive_path, archive_name, drive, CAST(0 AS BIGINT) AS file_count FROM arch WHERE archive_uuid = 'no-such-uuid'"""))
def q_archive_info_missing(spark, sf_dir):
    return ST.archive_info(cat(spark, sf_dir), "no-such-uuid")


_LIST_ARCH = """
SELECT archive_name, drive, archive_uuid,
       (SELECT COUNT(*) FROM ent e WHERE e.archive_uuid = a.archive_uuid) AS file_count, archive_path
FROM arch a"""


@register("list_archives_counts", with_catalog(_LIST_ARCH))
def q_list_archives_counts(spark, sf_dir):
    return ST.list_archives(cat(spark, sf_dir))


@register("list_archives_limit", with_catalog(_LIST_ARCH + " ORDER BY archive_name, archive_path LIMIT 7"))
def q_list_archives_limit(spark, sf_dir):
    return ST.list_archives(cat(spark, sf_dir), limit=7)


# ---- A-27 / A-28: per-drive rollup and totals over the catalogue ---------------------
_ROLLUP_SQL = f"""
SELECT d.drive, coalesce(r.zip_count, 0) AS zip_count, coalesce(r.video_count, 0) AS video_count,
       CAST(NULL AS VARCHAR) AS error, TRUE AS success
FROM (SELECT DISTINCT drive FROM arch) d
LEFT JOIN (
  SELECT a.drive, COUNT(*) AS zip_count, CAST(SUM(t.n) AS BIGINT) AS video_count
  FROM (SELECT archive_uuid, COUNT(*) AS n FROM ent
        WHERE {ext_of('path_in_archive')} IN ({VIDEO_EXT_SQL}) GROUP BY archive_uuid) t
  JOIN arch a USING (archive_uuid) GROUP BY a.drive) r USING (drive)"""


@register("drive_rollup", with_catalog(_ROLLUP_SQL))
def q_drive_rollup(spark, sf_dir):
    return ST.drive_rollup(cat(spark, sf_dir))


@register("scan_totals", with_catalog(f"""
SELECT CAST(coalesce(SUM(zip_count), 0) AS BIGINT) AS total_zips,
       CAST(coalesce(SUM(video_count), 0) AS BIGINT) AS total_videos,
       COUNT(*) AS drives, CAST(COUNT(*) AS BIGINT) AS drives_ok
FROM ({_ROLLUP_SQL}) x"""))
def q_scan_totals(spark, sf_dir):
    return ST.scan_totals(ST.drive_rollup(cat(spark, sf_dir)))


# ---- A-23: merge of catalogues ------------------------------------------------------------
@register("merge_catalogs", with_catalog("""
SELECT a.archive_path, CASE WHEN a.drive IN ('C:', 'D:') THEN 0 ELSE 1 END AS source_ord,
       (SELECT COUNT(*) FROM ent e WHERE e.archive_uuid = a.archive_uuid) AS file_count
FROM arch a"""))
def q_merge_catalogs(spark, sf_dir):
    # three overlapping sources (drives C+D, D+E, all); the first source having a path wins
    from zipledger.operators.merge import merge
    from zipledger.sources.catalog import Catalog
    c = cat(spark, sf_dir)

    def source(cond, seq):
        a = c.archives.filter(cond).withColumn("scan_seq", F.lit(seq).cast("long"))
        return Catalog(a, c.entries.join(a.select("archive_uuid"), "archive_uuid", "left_semi"))

    m = merge([source(F.col("drive").isin("C:", "D:"), 0), source(F.col("drive").isin("D:", "E:"), 1),
               source(F.lit(True), 2)])
    counts = m.entries.groupBy("archive_uuid").agg(F.count(F.lit(1)).alias("file_count"))
    return (m.archives.join(counts, "archive_uuid", "left")
            .select("archive_path", "source_ord", F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count")))


@register("report_choices", with_catalog(f"""
SELECT row_number() OVER (ORDER BY file_size DESC, archive_path, entry_ordinal) AS choice,
       substr(file_name, 1, 49) AS name_short, round(file_size / 1048576.0, 1) AS size_mb,
       substr(archive_name, 1, 29) AS archive_short
FROM ja WHERE {_like('vid-000')}"""))
def q_report_choices(spark, sf_dir):
    # numbered extraction choices: number, name[:49], MB, archive[:29]
    m = S.matched(cat(spark, sf_dir), P.like_contains("file_name", "vid-000"))
    n = S.number_choices(m, S.size_desc())
    return n.select("choice", T.clip("file_name", 49).alias("name_short"),
                    F.round(T.size_mb("file_size"), 1).alias("size_mb"),
                    T.clip("archive_name", 29).alias("archive_short"))


@register("report_list", with_catalog("""
SELECT substr(file_name, 1, 49) AS name_short, substr(archive_name, 1, 29) AS archive_short,
       round(file_size / 1048576.0, 1) AS size_mb, drive
FROM ja"""))
def q_report_list(spark, sf_dir):
    # list display of every entry: name[:49], archive[:29], MB, drive (ordered by name)
    return S.report_list(S.list_entries_full(cat(spark, sf_dir)))
