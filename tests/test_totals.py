"""Totals that the sink keeps per archive: no entries are read for counts and sums."""

import datetime as dt
import os
import zipfile

from zipledger.operators.analytics import archive_stats
from zipledger.operators.stats import archive_info, list_archives, summary
from zipledger.plans.scan import scan_and_register
from zipledger.sources.catalog import Catalog
from zipledger.sources.listing import roots_frame

TS = dt.datetime(2024, 1, 1)


def _zip(path, n):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for i in range(n):
            zf.writestr(f"v_{i}.mp4", b"v" * (10 + i))


def _same(cat):
    """Every report of a catalogue, and without its stored totals."""
    plain = Catalog(cat.archives, cat.entries)
    uuid = cat.archives.orderBy("archive_path").first()["archive_uuid"]
    reports = [summary, list_archives, lambda c: list_archives(c, 1), archive_stats, lambda c: archive_info(c, uuid)]
    for report in reports:
        with_totals, without = report(cat), report(plain)
        assert with_totals.columns == without.columns
        assert sorted(map(str, with_totals.collect())) == sorted(map(str, without.collect()))
        plan = with_totals._jdf.queryExecution().executedPlan().toString()
        assert "/archive_totals/" in plan or "archive_totals" in plan
        files = [f for f in with_totals.inputFiles() if "/entries/" in f]
        assert files == []
    return summary(cat).first()


def test_reports_read_no_entries(spark, scratch):
    path, roots = f"{scratch}/cat", roots_frame(spark, [f"{scratch}/r"], ["R:"])
    _zip(f"{scratch}/r/GoogleTakeout/a.zip", 4)
    _zip(f"{scratch}/r/GoogleTakeout/b.zip", 2)
    scan_and_register(spark, roots, path, "s1", scan_ts=TS)
    assert _same(Catalog.read(spark, path)).video_files == 6
    # a changed archive, a deleted one and a new one: totals of earlier runs are taken back
    _zip(f"{scratch}/r/GoogleTakeout/a.zip", 9)
    os.rename(f"{scratch}/r/GoogleTakeout/b.zip", f"{scratch}/r/GoogleTakeout/b.old")
    _zip(f"{scratch}/r/GoogleTakeout/c.zip", 1)
    scan_and_register(spark, roots, path, "s2", refresh=True, scan_ts=TS)
    row = _same(Catalog.read(spark, path))
    assert (row.zip_files, row.video_files, row.total_size) == (2, 10, sum(range(10, 19)) + 10)
    # a rerun replaces its own run
    scan_and_register(spark, roots, path, "s2", refresh=True, scan_ts=TS)
    assert _same(Catalog.read(spark, path)).video_files == 10


def test_runs_without_totals_are_counted(spark, scratch):
    # as written before totals were kept, next to a run that has them
    path = f"{scratch}/cat"
    for i, n in enumerate((3, 5)):
        _zip(f"{scratch}/r{i}/GoogleTakeout/a.zip", n)
        scan_and_register(spark, roots_frame(spark, [f"{scratch}/r{i}"], ["R:"]), path, f"s{i}", scan_ts=TS)
    os.rename(f"{path}/archive_totals/scan_id=s0", f"{scratch}/gone")
    cat = Catalog.read(spark, path)
    assert summary(cat).first().video_files == 8
    assert sorted(r.file_count for r in list_archives(cat).collect()) == [3, 5]
