"""Listing archives under a set of roots (drives, mounts, folders).

Two listing modes, as in the reference:

* ``all``: a recursive walk. Sub-directories whose name is exactly one of the
  excluded names are pruned before descending, symlinked directories are not
  followed, unreadable directories are skipped, and every non-directory whose
  lower-cased name ends with ``.zip`` is a candidate.
* ``takeout``: only the roots' direct children named ``googletakeout`` (any
  case) that are directories, and their direct children that are regular files
  ending with ``.zip``.

The walk is a breadth-first frontier expansion: the frontier of directories
is a DataFrame spread over tasks, one ``mapInPandas`` step lists every frontier
directory with ``os.scandir``, and the child directories become the next
frontier. Each level is written once to a staging table in the shared folder
(:func:`zipledger.session.materialize`), so a lost executor recomputes at most
one level and the plan does not grow with depth.

For object stores, :func:`list_binaryfile` lists with Spark's ``binaryFile``
source (path, length, modification time only; ``content`` is never selected).
Note that source skips names starting with ``_`` or ``.``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zipledger.functions.paths import EXCLUDED_DIRECTORIES, TAKEOUT_FOLDER, basename, drive_label
from zipledger.schemas import LISTING, WALK
from zipledger.session import checkpoint_root, materialize
from zipledger.sources.fs import file_exists
from zipledger.sources.reader import task_count

_WALK_COLS = [f.name for f in WALK.fields]


def roots_frame(spark: SparkSession, roots: Iterable[str], drives: Iterable[str] | None = None) -> DataFrame:
    """Roots as a DataFrame ``(root, drive)``; without a drive, archives take the label of their own path."""
    roots = list(roots)
    labels = list(drives) if drives is not None else [None] * len(roots)
    return spark.createDataFrame(list(zip(roots, labels)), "root string, drive string")


def filter_roots(roots: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Roots minus the excluded ones (``excluded`` has a ``root`` column)."""
    if excluded is None:
        return roots
    return roots.join(excluded.select("root").distinct(), "root", "left_anti")


def _list_dir(root, drive, d, depth, excl, follow_symlinks, chain=None, every=False):
    """WALK tuples for the children of directory ``d`` (one error tuple if unreadable):
    directories to descend into and archives, or ``every`` child.

    When links are followed, ``chain`` holds the real paths of ``d`` and its
    ancestors; a child directory that is one of them (a link cycle) is listed
    but not descended, so the walk ends while every alias is still visited.
    """
    if follow_symlinks and chain is None:
        chain = [os.path.realpath(d)]
    try:
        it = os.scandir(d)
    except OSError as e:
        yield (root, drive, d, "", d, False, False, None, None, int(depth), False, f"{type(e).__name__}: {e}", None)
        return
    with it:
        while True:
            try:
                ent = next(it)
            except (StopIteration, OSError):
                break
            try:
                is_dir = ent.is_dir()
            except OSError:
                is_dir = False
            try:
                is_link = ent.is_symlink()
            except OSError:
                is_link = False
            try:
                is_file = ent.is_file()
            except OSError:
                is_file = False
            descend = is_dir and (follow_symlinks or not is_link) and ent.name not in excl
            child_chain = None
            if descend and follow_symlinks:
                real = os.path.realpath(ent.path)
                if real in chain:
                    descend = False
                else:
                    child_chain = list(chain) + [real]
            size = mtime = None
            if not (descend or every or ent.name.lower().endswith(".zip")):
                continue
            if not is_dir:
                try:
                    st = os.stat(ent.path)
                    size, mtime = int(st.st_size), float(st.st_mtime)
                except OSError:
                    size, mtime = 0, None
            yield (root, drive, d, ent.name, ent.path, is_dir, is_file, size, mtime, int(depth) + 1, descend, None,
                   child_chain)


def _batched(rows, n=10000):
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= n:
            yield pd.DataFrame(out, columns=_WALK_COLS)
            out = []
    if out:
        yield pd.DataFrame(out, columns=_WALK_COLS)


def _scan_dirs(excluded: tuple[str, ...], follow_symlinks: bool, every: bool):
    excl = set(excluded)

    def rows(batches):
        for pdf in batches:
            chains = pdf["chain"] if "chain" in pdf.columns else [None] * len(pdf)
            for root, drive, d, depth, chain in zip(pdf["root"], pdf["drive"], pdf["dir"], pdf["depth"], chains):
                chain = None if chain is None else list(chain)
                yield from _list_dir(root, drive, d, depth, excl, follow_symlinks, chain, every)

    return lambda batches: _batched(rows(batches))


def _scan_takeout():
    """Per root: its ``googletakeout`` folders (any case) and their direct children.
    An unreadable root is skipped; an unreadable takeout folder yields an error row."""
    def rows(batches):
        for pdf in batches:
            for root, drive in zip(pdf["root"], pdf["drive"]):
                try:
                    with os.scandir(root) as it:
                        folders = []
                        for ent in it:
                            try:
                                if ent.name.lower() == TAKEOUT_FOLDER and ent.is_dir():
                                    folders.append(ent.path)
                            except OSError:
                                pass
                except OSError:
                    continue
                for folder in folders:
                    yield from _list_dir(root, drive, folder, 1, (), True)

    return lambda batches: _batched(rows(batches))


def _expand(frontier: DataFrame, excluded, follow_symlinks: bool, every: bool) -> DataFrame:
    parts = max(frontier.sparkSession.sparkContext.defaultParallelism, 2)
    return (frontier.repartition(parts)
            .mapInPandas(_scan_dirs(tuple(excluded), follow_symlinks, every), WALK))


def _to_listing(files: DataFrame) -> DataFrame:
    return files.select(
        "root", "drive", F.col("path").alias("archive_path"), basename("path").alias("archive_name"),
        F.col("file_size"), F.timestamp_seconds(F.col("mtime")).alias("last_modified"))


def walk(spark: SparkSession, roots: DataFrame, excluded: Iterable[str] = EXCLUDED_DIRECTORIES,
         follow_symlinks: bool = False, max_depth: int | None = None, every: bool = False) -> DataFrame:
    """The folders and archives below the roots (``WALK`` rows), or ``every`` entry, level by level."""
    checkpoint_root(spark)
    frontier = roots.select("root", "drive", F.col("root").alias("dir"), F.lit(0).alias("depth"),
                            F.lit(None).cast("array<string>").alias("chain"))
    levels = []
    depth = 0
    while True:
        level = materialize(_expand(frontier, excluded, follow_symlinks, every), "walk-level")
        levels.append(level)
        depth += 1
        nxt = level.filter(F.col("descend"))
        if (max_depth is not None and depth >= max_depth) or nxt.isEmpty():
            break
        frontier = nxt.select("root", "drive", F.col("path").alias("dir"), F.col("depth"), "chain")
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def list_all(spark: SparkSession, roots: DataFrame,
             excluded: Iterable[str] = EXCLUDED_DIRECTORIES, follow_symlinks: bool = False) -> DataFrame:
    """Recursive mode: every non-directory ending ``.zip`` (case-insensitive)."""
    w = walk(spark, roots, excluded, follow_symlinks)
    files = w.filter(F.col("error").isNull() & ~F.col("is_dir") & F.lower("name").endswith(".zip"))
    return _to_listing(files)


def list_takeout_rows(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """Takeout mode: ``WALK`` rows of the archives and errors in the roots' takeout folders."""
    checkpoint_root(spark)
    parts = max(spark.sparkContext.defaultParallelism, 2)
    inner = roots.select("root", "drive").repartition(parts).mapInPandas(_scan_takeout(), WALK)
    return inner.filter(F.col("error").isNotNull() | F.col("is_file") & F.lower("name").endswith(".zip"))


def split_takeout(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(listing, errors)``; ``errors`` are takeout folders that exist but cannot be
    listed (the drive then fails)."""
    errors = rows.filter(F.col("error").isNotNull()).select("drive", F.col("parent").alias("archive_path"), "error")
    return _to_listing(rows.filter(F.col("error").isNull())), errors


def list_takeout(spark: SparkSession, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takeout mode, listed when used: ``(listing, errors)``."""
    return split_takeout(list_takeout_rows(spark, roots))


def list_objects(spark: SparkSession, roots: DataFrame,
                 excluded: Iterable[str] = EXCLUDED_DIRECTORIES) -> DataFrame:
    """Recursive listing of object-store roots by Spark's file source (``list_binaryfile``).

    The roots are what the user named, a handful of locations."""
    out = None
    for root, drive in roots.select("root", "drive").collect():
        one = list_binaryfile(spark, root, excluded=excluded).withColumn("drive", F.lit(drive).cast("string"))
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], LISTING) if out is None else out


def list_binaryfile(spark: SparkSession, location: str, base: str | None = None,
                    drive_of=None, excluded: Iterable[str] = EXCLUDED_DIRECTORIES) -> DataFrame:
    """Recursive listing through Spark's ``binaryFile`` source (object stores).

    ``location`` may be a folder or a glob; ``base`` is the part of the path
    below which excluded directory names are pruned (default: ``location``).
    Only ``path``, ``length`` and ``modificationTime`` are selected, so file
    contents are never read. Unlike the walk, this source skips names that
    start with ``_`` or ``.``.
    """
    df = (spark.read.format("binaryFile")
          .option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.[zZ][iI][pP]")
          .load(location)
          .select("path", "length", "modificationTime"))
    path = F.regexp_replace("path", r"^file:", "")
    prefix = (base or location).rstrip("/")
    rel = F.substring(path, len(prefix) + 2, 1 << 30)
    dirs = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    keep = ~F.exists(dirs, lambda x: x.isin(list(excluded))) if excluded else F.lit(True)
    drive = drive_of(path) if drive_of else drive_label(path, "posix")
    return (df.filter(keep)
            .select(F.lit(prefix).alias("root"), drive.alias("drive"),
                    path.alias("archive_path"), basename(path).alias("archive_name"),
                    F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified")))


def dedupe_paths(listing: DataFrame) -> DataFrame:
    """One row per archive path (a path under two roots is scanned once).

    The first root in sort order wins; the choice is an aggregation with
    map-side combine, so many copies of one path never meet in one task.
    """
    rest = [c for c in listing.columns if c not in ("archive_path",)]
    return (listing.groupBy("archive_path")
            .agg(F.min(F.struct(*rest)).alias("s"))
            .select("archive_path", "s.*")
            .select(*[f.name for f in LISTING.fields]))


def _missing(batches):
    for pdf in batches:
        yield pdf[[not file_exists(path) for path in pdf["file"]]]


def missing(files: DataFrame) -> DataFrame:
    """The rows (column ``file``) whose file is not there; looked for on the executors. What cannot be told stays."""
    n = task_count(files.sparkSession, 0, 1)
    return files.repartition(n, "file").mapInPandas(_missing, files.schema)
