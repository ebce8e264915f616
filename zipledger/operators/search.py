"""Catalogue search and listing operators (archives joined with entries).

Every operator filters ``entries`` first (size predicates reach the Parquet
scan as pushed filters), projects the few columns it needs, and joins the
archive columns on ``archive_uuid``. The join strategy is left to Spark:
``archives`` is broadcast when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` (statically from file sizes, or at
runtime by AQE after a shuffle stage), and a sort-merge join is used otherwise.
All orders end with ``(archive_path, entry_ordinal)`` so ties, limits and
numbered choices are deterministic.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zipledger.functions.paths import like_contains, like_suffix, regex_find
from zipledger.functions.text import clip, size_mb
from zipledger.operators.ranking import global_row_number
from zipledger.sources.catalog import Catalog
from zipledger.sources.slices import with_place


def name_predicate(pattern: str | None, regex: bool = False, case_sensitive: bool = False,
                   ignore_case: bool = False, column: str = "file_name") -> Column:
    """LIKE ``%pattern%`` (ASCII case folded unless ``case_sensitive``) or regex find."""
    if regex:
        return regex_find(column, pattern or "", ignore_case)
    return like_contains(column, pattern or "", case_sensitive)


def entry_filter(pattern: str | None = "", regex: bool = False, min_size: int | None = None,
                 max_size: int | None = None, file_types: list[str] | None = None,
                 case_sensitive: bool = False, ignore_case: bool = False) -> Column:
    conds = [name_predicate(pattern, regex, case_sensitive, ignore_case)]
    if min_size is not None:
        conds.append(F.col("file_size") >= F.lit(min_size))
    if max_size is not None:
        conds.append(F.col("file_size") <= F.lit(max_size))
    if file_types:
        conds.append(reduce(or_, [like_suffix("file_name", "." + t) for t in file_types]))
    return reduce(lambda a, b: a & b, conds)


def _archive_side(cat: Catalog) -> DataFrame:
    return cat.archives.select("archive_uuid", "drive", "archive_name", "archive_path")


def _limit(df: DataFrame, limit: int | None) -> DataFrame:
    # 0 / None / negative mean "no limit", as in the reference
    return df.limit(limit) if limit and limit > 0 else df


def size_desc() -> list[Column]:
    """Largest first; ties by archive path and directory position."""
    return [F.col("file_size").desc(), F.col("archive_path").asc(), F.col("entry_ordinal").asc()]


def name_asc() -> list[Column]:
    """By file name (binary order); ties by archive path and directory position."""
    return [F.col("file_name").asc(), F.col("archive_path").asc(), F.col("entry_ordinal").asc()]


def matched(cat: Catalog, cond: Column) -> DataFrame:
    """Entries satisfying ``cond`` joined with their archive columns."""
    ent = with_place(cat.entries.filter(cond), "archive_uuid", "file_name", "file_size", "path_in_archive",
                     "entry_ordinal")
    return ent.join(_archive_side(cat), "archive_uuid")


def search(cat: Catalog, pattern: str | None = "", regex: bool = False, min_size: int | None = None,
           max_size: int | None = None, file_types: list[str] | None = None,
           case_sensitive: bool = False, ignore_case: bool = False,
           limit: int | None = None) -> DataFrame:
    """Search entries by name, size range and extension, largest first."""
    cond = entry_filter(pattern, regex, min_size, max_size, file_types, case_sensitive, ignore_case)
    res = matched(cat, cond).orderBy(*size_desc())
    res = _limit(res, limit)
    return res.select("drive", "archive_name", "archive_path", "file_name", "file_size", "path_in_archive")


def list_entries(cat: Catalog, limit: int | None = None) -> DataFrame:
    """All entries ordered by file name (binary order), optional limit."""
    res = _limit(matched(cat, F.lit(True)).orderBy(*name_asc()), limit)
    return res.select("file_name", "archive_name", "file_size", "drive")


def list_entries_full(cat: Catalog, limit: int | None = None) -> DataFrame:
    """``list_entries`` keeping the archive name for display."""
    return _limit(matched(cat, F.lit(True)).orderBy(*name_asc()), limit)


def report_list(df: DataFrame) -> DataFrame:
    """Display columns of a listing (name[:49], archive[:29], MB, drive)."""
    return df.select(clip("file_name", 49).alias("name_short"), clip("archive_name", 29).alias("archive_short"),
                     F.round(size_mb("file_size"), 1).alias("size_mb"), "drive")


def lookup_by_name(cat: Catalog, file_name: str) -> DataFrame:
    """Extraction lookup: entries whose name contains ``file_name``, largest first."""
    res = matched(cat, like_contains("file_name", file_name)).orderBy(*size_desc())
    return res.select("archive_path", "path_in_archive", "file_name", "file_size")


def entries_by_uuid(cat: Catalog, uuid: str, file_name: str | None = None) -> DataFrame:
    """Entries of one archive; with a name filter largest first, else by name."""
    cond = F.col("archive_uuid") == F.lit(uuid)
    if file_name:
        res = matched(cat, cond & like_contains("file_name", file_name)).orderBy(*size_desc())
    else:
        res = matched(cat, cond).orderBy(*name_asc())
    return res.select("archive_path", "path_in_archive", "file_name", "file_size", "archive_uuid")


def report_search(df: DataFrame) -> DataFrame:
    """Display columns of a search result (drive, archive[:29], name[:39], MB)."""
    return df.select("drive", clip("archive_name", 29).alias("archive_short"),
                     clip("file_name", 39).alias("name_short"),
                     F.round(size_mb("file_size"), 1).alias("size_mb"))


def number_choices(matches: DataFrame, order: list[Column]) -> DataFrame:
    """Matches numbered from 1 in the query's order (column ``choice``)."""
    return global_row_number(matches, order, "choice")


def pick(matches: DataFrame, order: list[Column], choice: int | str) -> DataFrame:
    """Select the ``choice``-th match, or every match for ``"all"``.

    An out-of-range number selects nothing; another string raises ``ValueError``.
    """
    if isinstance(choice, str):
        if choice.lower() != "all":
            raise ValueError(f"choice is a number or 'all', not {choice!r}")
        return number_choices(matches, order)
    if choice < 1:
        return matches.limit(0).withColumn("choice", F.lit(None).cast("long"))
    return (matches.orderBy(*order).offset(choice - 1).limit(1)
            .withColumn("choice", F.lit(choice).cast("long")))
