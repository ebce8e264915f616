"""Merging catalogues (the reference merges per-thread stores into one).

Sources are unioned with their position; an archive path is kept once, from
the first source that has it, and an archive uuid is kept once as well. Both
choices are ``min_by`` aggregations (map-side combine), so a path present in
many sources never gathers all its copies in one task. Entries follow their
surviving ``(archive_uuid, source_ord)``; entries of dropped copies go away,
so no orphan entries appear.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zipledger.sources.catalog import ARCHIVE_COLS, ENTRY_COLS, Catalog
from zipledger.sources.fs import path_exists


def merge(catalogs: Iterable[Catalog]) -> Catalog:
    cats = list(catalogs)
    if not cats:
        raise ValueError("nothing to merge")
    arch: DataFrame | None = None
    ent: DataFrame | None = None
    for i, c in enumerate(cats):
        a = c.archives.select(*ARCHIVE_COLS).withColumn("source_ord", F.lit(i))
        e = c.entries.select(*ENTRY_COLS).withColumn("source_ord", F.lit(i))
        arch = a if arch is None else arch.unionByName(a)
        ent = e if ent is None else ent.unionByName(e)
    cols = [c for c in ARCHIVE_COLS + ["source_ord"]]
    by_path = (arch.groupBy("archive_path")
               .agg(F.min_by(F.struct(*[c for c in cols if c != "archive_path"]),
                             F.struct("source_ord", "archive_uuid")).alias("a"))
               .select("archive_path", "a.*"))
    by_uuid = (by_path.groupBy("archive_uuid")
               .agg(F.min_by(F.struct(*[c for c in cols if c != "archive_uuid"]),
                             F.struct("source_ord", "archive_path")).alias("a"))
               .select("archive_uuid", "a.*"))
    entries = ent.join(by_uuid.select("archive_uuid", "source_ord"), ["archive_uuid", "source_ord"], "left_semi")
    return Catalog(by_uuid.select(*cols), entries)


def merge_paths(spark: SparkSession, paths: Iterable[str]) -> Catalog:
    """Merge stored catalogues; a missing source is skipped."""
    cats = [Catalog.read(spark, p) for p in paths if path_exists(f"{p}/archives", spark)]
    return merge(cats)
