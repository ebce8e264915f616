"""User-facing facade: the catalogue commands as methods returning DataFrames.

    ledger = Ledger(spark, "/shared/catalog")
    ledger.scan(["/mnt/c", "/mnt/d"])                 # takeout mode, video entries
    ledger.search("holiday", min_size=10 << 20, file_types=["mp4"]).show()
    ledger.extract("holiday_001.mp4", "/shared/out", choice=1)

Every method builds a Spark plan over the stored catalogue; nothing is
collected. Interactive prompts of a console tool become the ``choice``
argument (a number, or ``"all"``).
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid as _uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from zipledger.functions.paths import EXCLUDED_DIRECTORIES, like_contains
from zipledger.operators import extract as X
from zipledger.operators import search as S
from zipledger.operators import stats as ST
from zipledger.operators.merge import merge_paths
from zipledger.plans.register import expire, register
from zipledger.plans.scan import ScanResult, scan_and_register
from zipledger.session import ship_package
from zipledger.schemas import EXTRACT_RESULT
from zipledger.sources.catalog import Catalog, published_runs, read_table
from zipledger.sources.fs import path_exists
from zipledger.sources.listing import roots_frame


class Ledger:
    def __init__(self, spark: SparkSession, catalog_path: str, path_style: str = "posix", audit: bool = True):
        """``path_style`` labels archives by their paths; ``audit=False`` keeps no audit trail
        (it writes a small file for every command)."""
        ship_package(spark)
        self.audited = audit
        self.spark = spark
        self.path = catalog_path.rstrip("/")
        self.path_style = path_style

    # ---- audit trail (append-only) ----------------------------------------------------
    def _audit(self, op: str, **args) -> None:
        if not self.audited:
            return
        row = [(op, json.dumps(args, sort_keys=True, default=str), _dt.datetime.now())]
        (self.spark.createDataFrame(row, "op string, args string, at timestamp")
         .coalesce(1).write.mode("append").parquet(f"{self.path}/audit"))

    def audit_log(self) -> DataFrame:
        if not path_exists(f"{self.path}/audit", self.spark):
            return self.spark.createDataFrame([], "op string, args string, at timestamp")
        return self.spark.read.parquet(f"{self.path}/audit")

    def usage(self) -> DataFrame:
        """Commands run against this catalogue: count, first and last time."""
        return (self.audit_log().groupBy("op")
                .agg(F.count(F.lit(1)).alias("runs"), F.min("at").alias("first"), F.max("at").alias("last")))

    # ---- catalogue -------------------------------------------------------------------
    def catalog(self) -> Catalog:
        return Catalog.read(self.spark, self.path)

    def scan(self, roots: Iterable[str], drives: Iterable[str] | None = None, mode: str = "takeout",
             all_files: bool = False, excluded: Iterable[str] = EXCLUDED_DIRECTORIES,
             exclude_roots: Iterable[str] = (), scan_id: str | None = None,
             extensions: Iterable[str] | None = None, follow_symlinks: bool = False,
             nested: bool = False, resume: bool = False, refresh: bool = False) -> ScanResult:
        """Scan roots and register what was found (one Spark job set, all roots in parallel).

        Without ``drives``, archives are labelled by their paths in the ledger's path style.
        ``refresh`` reads registered archives again that have changed and retires those that are gone."""
        roots = [r for r in roots if r not in set(exclude_roots)]
        rf = roots_frame(self.spark, roots, drives)
        sid = scan_id or _dt.datetime.now().strftime("%Y%m%dT%H%M%S") + "-" + _uuid.uuid4().hex[:6]
        seq = len(published_runs(self.spark, self.path))
        self._audit("scan", roots=roots, mode=mode, all_files=all_files, scan_id=sid)
        return scan_and_register(self.spark, rf, self.path, sid, mode=mode, all_files=all_files,
                                 excluded=excluded, scan_seq=seq, path_style=self.path_style,
                                 extensions=extensions, follow_symlinks=follow_symlinks, nested=nested,
                                 resume=resume, refresh=refresh)

    def expire(self, older_than: _dt.timedelta = _dt.timedelta(days=1)) -> list[str]:
        """Remove the files of replaced and failed runs that are older than that; their run ids."""
        self._audit("expire", seconds=older_than.total_seconds())
        return expire(self.spark, self.path, older_than)

    def merge(self, source_paths: Iterable[str], scan_id: str = "merged") -> None:
        """Merge other catalogues into this one (first source wins, missing skipped)."""
        self._audit("merge", sources=list(source_paths), scan_id=scan_id)
        m = merge_paths(self.spark, [self.path] + list(source_paths) if path_exists(f"{self.path}/archives", self.spark)
                        else list(source_paths))
        register(self.path, m.archives.drop("source_ord"), m.entries.drop("source_ord"), scan_id)

    # ---- queries ---------------------------------------------------------------------
    def search(self, pattern: str = "", regex: bool = False, min_size: int | None = None,
               max_size: int | None = None, file_types: list[str] | None = None,
               ignore_case: bool = False, limit: int | None = None) -> DataFrame:
        self._audit("search", pattern=pattern, regex=regex, min_size=min_size, max_size=max_size,
                    file_types=file_types, limit=limit)
        return S.search(self.catalog(), pattern, regex, min_size, max_size, file_types,
                        ignore_case=ignore_case, limit=limit)

    def list_videos(self, limit: int | None = None) -> DataFrame:
        return S.list_entries(self.catalog(), limit)

    def list_archives(self, limit: int | None = None) -> DataFrame:
        return ST.list_archives(self.catalog(), limit)

    def stats(self) -> DataFrame:
        return ST.summary(self.catalog())

    def archive_info(self, uuid: str) -> DataFrame:
        return ST.archive_info(self.catalog(), uuid)

    def files_in_archive(self, uuid: str, file_name: str | None = None) -> DataFrame:
        return S.entries_by_uuid(self.catalog(), uuid, file_name)

    # ---- extraction ------------------------------------------------------------------
    def extract(self, file_name: str, output_dir: str, choice: int | str = 1) -> DataFrame:
        """Extract a match of ``file_name`` (largest first): number ``choice`` or ``"all"``."""
        self._audit("extract", file_name=file_name, output_dir=output_dir, choice=choice)
        m = S.matched(self.catalog(), like_contains("file_name", file_name))
        return self._record(X.extract(S.pick(m, S.size_desc(), choice).drop("choice"), S.size_desc(), output_dir))

    def extract_by_uuid(self, uuid: str, output_dir: str, file_name: str | None = None,
                        choice: int | str = 1) -> DataFrame:
        """Extract from one archive: match number ``choice``, or ``"all"``."""
        self._audit("extract_by_uuid", uuid=uuid, file_name=file_name, output_dir=output_dir, choice=choice)
        cond = F.col("archive_uuid") == uuid
        if file_name:
            cond = cond & like_contains("file_name", file_name)
        order = S.size_desc() if file_name else S.name_asc()
        m = S.matched(self.catalog(), cond)
        return self._record(X.extract(S.pick(m, order, choice).drop("choice"), order, output_dir))

    def extract_all(self, output_dir: str) -> DataFrame:
        """Every catalogued entry, archives by name, entries by file name."""
        self._audit("extract_all", output_dir=output_dir)
        order = [F.col("archive_name"), F.col("archive_path"), F.col("file_name"), F.col("entry_ordinal")]
        return self._record(X.extract(S.matched(self.catalog(), F.lit(True)), order, output_dir))

    def extract_by_rules(self, rules: list, output_dir: str, default: str = "other") -> DataFrame:
        """Every catalogued entry into the sub-folder of the first rule (condition, folder) it meets."""
        self._audit("extract_by_rules", folders=[f for _, f in rules], output_dir=output_dir)
        return self._record(X.extract_by_rules(S.matched(self.catalog(), F.lit(True)), S.size_desc(), output_dir,
                                               rules, default))

    def _record(self, results: DataFrame) -> DataFrame:
        """Append an extraction's result rows to the catalogue's history."""
        results.withColumn("at", F.lit(_dt.datetime.now())).write.mode("append").parquet(f"{self.path}/extractions")
        return results

    def extraction_history(self) -> DataFrame:
        """The result rows of all extractions from this catalogue, with their time ``at``."""
        schema = StructType([*EXTRACT_RESULT.fields, StructField("at", TimestampType(), True)])
        return read_table(self.spark, f"{self.path}/extractions", schema)

    def extraction_tally(self, results: DataFrame) -> DataFrame:
        return ST.extract_tally(results)

    # ---- documented extras --------------------------------------------------------------
    def duplicates(self) -> DataFrame:
        """Groups of identical contents (size + sha256), hashing only size collisions."""
        from zipledger.operators.quality import duplicates_by_content
        return duplicates_by_content(self.catalog())

    def validate(self, roots: Iterable[str] | None = None, drives: Iterable[str] | None = None,
                 mode: str = "takeout") -> dict[str, DataFrame]:
        """Integrity checks; with ``roots`` also missing archives and size drift."""
        from zipledger.operators import quality as Q
        c = self.catalog()
        out = {"orphan_entries": Q.orphan_entries(c), "empty_archives": Q.empty_archives(c),
               "duplicate_paths": Q.duplicate_paths(c.archives)}
        if roots is not None:
            from zipledger.plans.scan import list_roots
            listing, _ = list_roots(self.spark, roots_frame(self.spark, list(roots), drives), mode)
            out["missing_archives"] = Q.missing_archives(c, listing)
            out["size_drift"] = Q.size_drift(c, listing)
        return out

    def export(self, df: DataFrame, path: str, fmt: str = "csv") -> None:
        """Write a result as CSV (with header), JSON lines or XML (an element ``row`` each)."""
        w = df.write.mode("overwrite")
        if fmt == "xml":
            w.format("xml").option("rowTag", "row").save(path)
            return
        (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))

    def archive_stats(self) -> DataFrame:
        from zipledger.operators.analytics import archive_stats
        return archive_stats(self.catalog())

    def timeline(self, unit: str = "month") -> DataFrame:
        from zipledger.operators.analytics import timeline
        return timeline(self.catalog().entries, unit)

    def search_text(self, pattern: str, extensions=(".txt",), ignore_case: bool = False) -> DataFrame:
        from zipledger.operators.analytics import search_text
        return search_text(self.catalog(), pattern, extensions, ignore_case)

    def watch(self, folders: str, checkpoint_location: str, all_files: bool = False,
              available_now: bool = True, max_files_per_trigger: int | None = None):
        """Register new archives appearing under ``folders`` (a path or glob) as they
        arrive; returns the StreamingQuery (``available_now`` stops when caught up)."""
        from zipledger.streaming.watch import watch
        self._audit("watch", folders=folders, available_now=available_now)
        return watch(self.spark, folders, self.path, checkpoint_location, all_files=all_files,
                     available_now=available_now, max_files_per_trigger=max_files_per_trigger,
                     path_style=self.path_style)
