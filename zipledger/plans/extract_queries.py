"""Registered extraction queries (plan, names, run, tallies) over the fixture.

The fixture catalogue is the one the scan job registers from the packed
``documents`` archives (video entries only); every run extracts into a fresh
folder below the shared folder.
"""

from __future__ import annotations

import uuid as _uuid

from pyspark.sql import functions as F

from zipledger.functions.ids import archive_uuid_py
from zipledger.functions.paths import basename, like_contains
from zipledger.operators import extract as X
from zipledger.operators import search as S
from zipledger.operators.alloc import allocate
from zipledger.operators.stats import extract_tally
from zipledger.plans.oracle_sql import ENT0, ext_of
from zipledger.plans.registry import UUID_PATH, VIDEO_EXT_SQL, register
from zipledger.plans.scan_queries import _run_scan_job, rel
from zipledger.session import shared_dir
from zipledger.sources.catalog import Catalog
from zipledger.sources.fs import path_exists


def fixture_catalog(spark, sf_dir):
    """(fixture root, registered fixture catalogue); the scan job runs once."""
    from zipledger.plans.scan_queries import _catalog_path, fixture
    base, _ = fixture(spark, sf_dir)
    path = _catalog_path(spark, sf_dir)
    if not path_exists(f"{path}/manifest", spark):
        _run_scan_job(spark, sf_dir, path)
    return base, Catalog.read(spark, path)


def full_catalog(spark, sf_dir):
    """(fixture root, catalogue of all files of the fixture archives); scanned once."""
    import datetime as _dt

    from zipledger.plans.scan import scan_and_register
    from zipledger.plans.scan_queries import _catalog_path, fixture
    base, roots = fixture(spark, sf_dir)
    path = _catalog_path(spark, sf_dir) + "-all"
    if not path_exists(f"{path}/manifest", spark):
        scan_and_register(spark, roots, path, "all-files", all_files=True, scan_ts=_dt.datetime(2024, 1, 2), scan_seq=1)
    return base, Catalog.read(spark, path)


def fresh_output(spark) -> str:
    return shared_dir(spark, "zipledger-extract", _uuid.uuid4().hex)


_V = f"""
v AS (
  SELECT *, lang || '/' || file_name AS path_in_archive FROM ent0
  WHERE {ext_of("lang || '/' || file_name")} IN ({VIDEO_EXT_SQL})
)"""


def _with_v(select_sql: str) -> str:
    return f"WITH {ENT0.strip()},{_V}\n{select_sql.strip()}"


@register("alloc_names", _with_v(r"""
SELECT p.pass, archive_path AS rel_path, path_in_archive,
       CASE WHEN p.pass = 0 THEN file_name ELSE regexp_replace(file_name, '(\.[^.]*)$', '_1\1') END AS out_name
FROM v, (SELECT 0 AS pass UNION ALL SELECT 1) p"""))
def q_alloc_names(spark, sf_dir):
    # all entries planned twice into one folder: the second pass collides
    base, cat = fixture_catalog(spark, sf_dir)
    m = S.matched(cat, F.lit(True))
    twice = m.withColumn("pass", F.lit(0)).unionByName(m.withColumn("pass", F.lit(1)))
    numbered = X.global_row_number(twice, [F.col("pass")] + S.size_desc(), "plan_pos")
    named = allocate(numbered.withColumn("base", basename("path_in_archive")))
    return named.select("pass", rel(base).alias("rel_path"), "path_in_archive", "out_name")


_RUN_COLS = "archive_path AS rel_path, path_in_archive, file_name AS out_name, 'ok' AS status, " \
            "file_size AS bytes_written, sha256(text) AS sha256"


def _result_cols(base, res):
    return res.select(rel(base).alias("rel_path"), "path_in_archive",
                      F.substring_index("output_path", "/", -1).alias("out_name"),
                      "status", "bytes_written", "sha256")


@register("extract_run", _with_v(f"""
SELECT {_RUN_COLS} FROM v JOIN documents d USING (doc_id)
WHERE translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%.mov%'"""))
def q_extract_run(spark, sf_dir):
    base, cat = fixture_catalog(spark, sf_dir)
    m = S.matched(cat, like_contains("file_name", ".MOV"))
    res = X.extract(m, S.size_desc(), fresh_output(spark))
    return _result_cols(base, res)


@register("extract_by_uuid", _with_v(f"""
SELECT {_RUN_COLS} FROM v JOIN documents d USING (doc_id)
WHERE archive_path = '{UUID_PATH}'"""))
def q_extract_by_uuid(spark, sf_dir):
    # every entry of one archive
    base, cat = fixture_catalog(spark, sf_dir)
    uuid = archive_uuid_py(base + UUID_PATH)
    m = S.matched(cat, F.col("archive_uuid") == uuid)
    chosen = S.pick(m, S.size_desc(), "all").drop("choice")
    res = X.extract(chosen, S.size_desc(), fresh_output(spark))
    return _result_cols(base, res)


def _all_order():
    return [F.col("archive_name"), F.col("archive_path"), F.col("file_name"), F.col("entry_ordinal")]


def _extract_all(spark, sf_dir):
    base, cat = fixture_catalog(spark, sf_dir)
    m = S.matched(cat, F.lit(True))
    return base, X.extract(m, _all_order(), fresh_output(spark))


@register("extract_all", _with_v(f"SELECT {_RUN_COLS} FROM v JOIN documents d USING (doc_id)"))
def q_extract_all(spark, sf_dir):
    base, res = _extract_all(spark, sf_dir)
    return _result_cols(base, res)


@register("extract_tally", _with_v("""
SELECT archive_path AS rel_path, COUNT(*) AS extracted, CAST(0 AS BIGINT) AS errors
FROM v GROUP BY ROLLUP (archive_path)"""))
def q_extract_tally(spark, sf_dir):
    base, res = _extract_all(spark, sf_dir)
    t = extract_tally(res)
    return t.select(F.when(F.col("archive_path").isNull(), F.lit(None))
                    .otherwise(rel(base)).alias("rel_path"), "extracted", "errors")


@register("extract_validate", _with_v("SELECT archive_path AS rel_path, path_in_archive, 'valid' AS verdict FROM v"))
def q_extract_validate(spark, sf_dir):
    # every extracted file checked against the content hashes of the derived catalogue
    from zipledger.plans.registry import cat as derived
    base, res = _extract_all(spark, sf_dir)
    d = derived(spark, sf_dir)
    expected = (d.entries.join(d.archives.select("archive_uuid", "archive_path"), "archive_uuid")
                .select(F.concat(F.lit(base), F.col("archive_path")).alias("archive_path"),
                        "path_in_archive", "file_size", "file_hash"))   # paths are unique there
    v = X.validate(res, expected)
    return v.select(rel(base).alias("rel_path"), "path_in_archive", "verdict")


@register("extract_resume", _with_v(r"""
SELECT archive_path AS rel_path, path_in_archive FROM v
WHERE translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') NOT LIKE '%.mov%'"""))
def q_extract_resume(spark, sf_dir):
    # a first run extracted the entries of one type; resuming with all entries leaves the rest
    base, cat = fixture_catalog(spark, sf_dir)
    first = X.extract(S.matched(cat, like_contains("file_name", ".mov")), S.size_desc(), fresh_output(spark))
    todo = X.remaining(S.matched(cat, F.lit(True)), first)
    return todo.select(rel(base).alias("rel_path"), "path_in_archive")
