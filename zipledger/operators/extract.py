"""Distributed extraction of catalogued entries.

1. **Plan**: the selected entries are numbered in the query's order
   (``plan_pos``, :func:`global_row_number`), and every entry gets its output
   name from the collision rule (:func:`zipledger.operators.alloc.allocate`)
   *before* anything is written, so a retried task writes the same names.
2. **Run**: the plan is dealt in slices of even bytes (:mod:`zipledger.sources.slices`);
   a task opens each of its archives once and copies its entries in 1 MiB
   chunks to a temporary name (in a folder of the task), then links it to its
   own, which fails if another file has taken that name since. An entry is what its archive holds at its
   ordinal, so entries of one name are each extracted with their own bytes.
   Missing entries and unreadable archives become error rows, not failures.
3. The results are written once to a table in the shared folder, so the side
   effects happen once per run and later queries (tallies) reuse them.

Output folders must be visible to every executor: a shared mount, or a URI that
pyarrow writes to.
"""

from __future__ import annotations

import filecmp
import hashlib
import os
import uuid as _uuid
from contextlib import closing
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zipledger.functions.paths import basename
from zipledger.operators.alloc import allocate
from zipledger.operators.ranking import global_row_number
from zipledger.schemas import EXTRACT_RESULT
from zipledger.session import materialize
from zipledger.sources.fs import local_path
from zipledger.sources.slices import each_entry, sliced, told, with_place

COPY_BYTES = 1 << 20
_RES_COLS = [f.name for f in EXTRACT_RESULT.fields]


def _names(batches):
    for pdf in batches:
        for folder in pdf["folder"]:
            local = local_path(folder)
            if local is not None:
                names = os.listdir(local) if os.path.isdir(local) else []
            else:
                from pyarrow import fs as pafs
                filesystem, inner = pafs.FileSystem.from_uri(folder)
                chosen = pafs.FileSelector(inner, allow_not_found=True)
                names = [i.base_name for i in filesystem.get_file_info(chosen)]
            for i in range(0, len(names), 10000):
                yield pd.DataFrame({"name": names[i:i + 10000]})


def existing_names(spark, output_dir: str) -> DataFrame:
    """Names already present in ``output_dir``, as the executors see it."""
    folder = spark.createDataFrame([(output_dir,)], "folder string")
    return materialize(folder.mapInPandas(_names, "name string"), "existing-names")


def plan(matches: DataFrame, order: list[Column], output_dir: str,
         existing: DataFrame | None = None, folder: Column | None = None) -> DataFrame:
    """``(plan_pos, archive_path, path_in_archive, file_name, file_size, out_name, output_path)``.

    ``folder`` is the sub-folder of each match; names are allocated within it, and
    ``existing`` then has names with their folder."""
    numbered = global_row_number(matches, order, "plan_pos")
    base = basename("path_in_archive")
    with_base = numbered.withColumn("base", base if folder is None else F.concat(folder, F.lit("/"), base))
    named = allocate(with_base, existing)
    out_dir = output_dir.rstrip("/")
    ordinal = F.col("entry_ordinal") if "entry_ordinal" in named.columns else F.lit(None).cast("int")
    named = named.withColumn("entry_ordinal", ordinal).withColumn(
        "output_path", F.concat(F.lit(out_dir + "/"), F.col("out_name")))
    return with_place(named, "plan_pos", "archive_path", "path_in_archive", "file_name", "file_size",
                      "entry_ordinal", "out_name", "output_path")


def _publish(tmp: str, target: str) -> None:
    """Give a finished file its name unless a file that is not ours has it."""
    try:
        os.link(tmp, target)   # fails if the name is taken, atomically
    except FileExistsError:
        if not filecmp.cmp(tmp, target, shallow=False):   # the same bytes: an earlier attempt of this task
            raise
    os.remove(tmp)


def _pour(src, dst) -> tuple[int, str]:
    h, n = hashlib.sha256(), 0
    while chunk := src.read(COPY_BYTES):
        dst.write(chunk)
        h.update(chunk)
        n += len(chunk)
    return n, h.hexdigest()


def _copy_remote(src, filesystem, target: str) -> tuple[int, str]:
    """Write a stream below a name of this attempt, then move it to its own.

    A task lost half-way leaves no file under the target's name. If the name is taken, the
    file there is either what an earlier attempt of this task finished (the same bytes:
    done) or a foreign one, which stays as it is. A store has no link that fails where a
    file is; the look at the name comes right before the move."""
    from pyarrow import fs as pafs
    tmp = f"{target}.{_uuid.uuid4().hex}.part"
    parent = target.rpartition("/")[0]
    if parent:
        filesystem.create_dir(parent, recursive=True)
    try:
        with filesystem.open_output_stream(tmp) as dst:
            n, digest = _pour(src, dst)
        there = filesystem.get_file_info(target)
        if there.type == pafs.FileType.NotFound:
            filesystem.move(tmp, target)
            return n, digest
        if there.type != pafs.FileType.File or there.size != n:
            raise FileExistsError(target)
        h = hashlib.sha256()
        with filesystem.open_input_stream(target) as old:
            while chunk := old.read(COPY_BYTES):
                h.update(chunk)
        if h.hexdigest() != digest:
            raise FileExistsError(target)
        return n, digest
    finally:
        if filesystem.get_file_info(tmp).type != pafs.FileType.NotFound:
            filesystem.delete_file(tmp)


class Unfinished:
    """A task's unfinished files: in a folder of its own within each output folder.

    A folder lets in or out one name at a time, whichever task asks for it. Temporary names are kept out of the
    folder that all tasks share, so an entry changes it once, by its link."""

    def __init__(self):
        self.folders: dict[str, str] = {}

    def file(self, target: str) -> str:
        """A name for the unfinished file of ``target``, one file at a time."""
        folder = os.path.dirname(target) or "."
        if folder not in self.folders:
            os.makedirs(own := f"{folder}/.{_uuid.uuid4().hex}.parts")
            self.folders[folder] = own
        return f"{self.folders[folder]}/part"

    def close(self) -> None:
        for own in self.folders.values():
            os.rmdir(own)
        self.folders = {}


def _copy(src, target: str, unfinished: Unfinished | None = None) -> tuple[int, str]:
    """Write a stream to a path or URI; (bytes, sha256)."""
    local = local_path(target)
    if local is None:
        from pyarrow import fs as pafs
        return _copy_remote(src, *pafs.FileSystem.from_uri(target))
    if unfinished is None:
        with closing(Unfinished()) as one:
            return _copy(src, target, one)
    tmp = unfinished.file(local)
    try:
        with open(tmp, "wb") as dst:
            written = _pour(src, dst)
        _publish(tmp, local)
    except BaseException:
        if os.path.exists(tmp):
            os.remove(tmp)
        raise
    return written


def _extract_entry(opened, row, unfinished: Unfinished | None = None) -> tuple:
    path, member, ordinal = row["archive_path"], row["path_in_archive"], row["entry_ordinal"]
    ordinal = None if pd.isna(ordinal) else int(ordinal)
    key = (int(row["plan_pos"]), path, member, ordinal, row["output_path"])
    try:
        src = opened.placed(row)
        if src is None:
            opened.entry(path, 0) if ordinal is None else None
            infos = opened.infos if ordinal is None else [opened.entry(path, ordinal)]
            # without an ordinal the last of the entries with the name is meant
            info = next((i for i in reversed(infos) if i.filename == member), None)
            if info is None:
                raise IndexError
            src = opened.zip.open(info)
    except IndexError:
        return (*key, "missing", None, None, f"File '{member}' not found in ZIP archive")
    except Exception as e:
        return (*key, "error", None, None, told(e))
    try:
        with src:
            return (*key, "ok", *_copy(src, row["output_path"], unfinished), None)
    except Exception as e:
        return (*key, "error", None, None, told(e))


def _extract_entries(batches):
    with closing(Unfinished()) as unfinished:
        yield from each_entry(partial(_extract_entry, unfinished=unfinished), _RES_COLS)(batches)


def run(planned: DataFrame) -> DataFrame:
    """Execute a plan once; returns the result rows (``EXTRACT_RESULT``)."""
    ordinal = F.col("entry_ordinal") if "entry_ordinal" in planned.columns else F.lit(None).cast("int")
    work = with_place(planned.withColumn("entry_ordinal", ordinal), "plan_pos", "archive_path", "path_in_archive",
                      "entry_ordinal", "output_path", "file_size")
    work = sliced(work, "entry_ordinal", "plan_pos", size="file_size")
    return materialize(work.mapInPandas(_extract_entries, EXTRACT_RESULT), "extract-results")


def extract(matches: DataFrame, order: list[Column], output_dir: str, skip_existing_scan: bool = False) -> DataFrame:
    """Plan and run the extraction of ``matches`` into ``output_dir``."""
    spark = matches.sparkSession
    existing = None if skip_existing_scan else existing_names(spark, output_dir)
    return run(plan(matches, order, output_dir, existing))


def folder_of(rules: list[tuple[Column, str]], default: str = "other") -> Column:
    """The folder of the first rule (condition, folder) that an entry meets."""
    out = F.lit(default)
    for condition, folder in reversed(rules):
        out = F.when(condition, F.lit(folder)).otherwise(out)
    return out


def extract_by_rules(matches: DataFrame, order: list[Column], output_dir: str, rules: list[tuple[Column, str]],
                     default: str = "other") -> DataFrame:
    """Extract ``matches`` into sub-folders of ``output_dir`` chosen by ``rules``."""
    spark, existing = matches.sparkSession, None
    for folder in dict.fromkeys([f for _, f in rules] + [default]):
        names = existing_names(spark, f"{output_dir.rstrip('/')}/{folder}").select(
            F.concat(F.lit(folder + "/"), "name").alias("name"))
        existing = names if existing is None else existing.unionByName(names)
    return run(plan(matches, order, output_dir, existing, folder_of(rules, default)))


_ENTRY = ["archive_path", "path_in_archive", "entry_ordinal"]


def _same_entry(left: DataFrame, right: DataFrame):
    """Entries are the same by archive, path and place; where a side has no place, by path."""
    same = (left["archive_path"] == right["archive_path"]) & (left["path_in_archive"] == right["path_in_archive"])
    if "entry_ordinal" in left.columns and "entry_ordinal" in right.columns:
        same = same & (left["entry_ordinal"] == right["entry_ordinal"])
    return same


def remaining(matches: DataFrame, results: DataFrame) -> DataFrame:
    """Matches a previous run has not extracted successfully (resume)."""
    done = results.filter(F.col("status") == "ok").select(*_ENTRY)
    return matches.join(done, _same_entry(matches, done), "left_anti")


def validate(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Check extracted files against expected ``file_size`` and ``file_hash``.

    ``expected`` has ``archive_path, path_in_archive, entry_ordinal, file_size, file_hash``
    (the hash may be NULL, then only the size is checked).
    """
    j = results.join(expected, _same_entry(results, expected), "left").select(
        results["*"], expected["file_size"], expected["file_hash"])
    verdict = (F.when(F.col("status") != "ok", F.col("status"))
               .when(F.col("file_size").isNull(), F.lit("unknown"))
               .when(F.col("bytes_written") != F.col("file_size"), F.lit("size_mismatch"))
               .when(F.col("file_hash").isNotNull() & (F.col("sha256") != F.col("file_hash")), F.lit("hash_mismatch"))
               .otherwise(F.lit("valid")))
    return j.select("archive_path", "path_in_archive", "entry_ordinal", "output_path", verdict.alias("verdict"))
