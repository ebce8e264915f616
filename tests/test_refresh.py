"""Snapshots, expiry, refresh scans and the reader format."""

import datetime as dt
import os
import time
import zipfile

from zipledger.api import Ledger
from zipledger.operators.search import list_entries
from zipledger.plans.register import expire
from zipledger.plans.scan import scan_and_register
from zipledger.schemas import SCAN_PROGRESS
from zipledger.sources.catalog import Catalog, published_runs, visible
from zipledger.sources.datasource import register_source
from zipledger.sources.listing import roots_frame
from zipledger.streaming.watch import watch


def _zip(path, *names):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path + ".part", "w") as zf:
        for name in names:
            zf.writestr(name, name.encode())
    os.replace(path + ".part", path)


def _seen(spark, catalog):
    c = Catalog.read(spark, catalog)
    rows = c.entries.join(c.archives.select("archive_uuid", "archive_name"), "archive_uuid")
    return sorted((r.archive_name, r.file_name) for r in rows.collect())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _run_folders(catalog, table="entries"):
    return [d for scan in os.listdir(f"{catalog}/{table}") if scan.startswith("scan_id=")
            for d in os.listdir(f"{catalog}/{table}/{scan}") if d.startswith("run_id=")]


def test_ten_reruns_read_one_run(spark, scratch):
    catalog, roots = f"{scratch}/catalog", roots_frame(spark, [f"{scratch}/r"])
    _zip(f"{scratch}/r/a.zip", "a.mp4", "b.mp4")
    for _ in range(4):
        scan_and_register(spark, roots, catalog, "s", mode="all")
    entries = Catalog.read(spark, catalog).entries
    (_, run), = published_runs(spark, catalog)
    plan = _plan(entries)
    assert "run_id#" in plan.split("PartitionFilters")[1] and run in plan and "Join" not in plan
    assert len(entries.inputFiles()) <= 4 * 8 and len(_run_folders(catalog)) == 4
    assert expire(spark, catalog) == []                     # too young
    gone = expire(spark, catalog, dt.timedelta(0))
    assert len(gone) == 3 and _run_folders(catalog) == [f"run_id={run}"] == _run_folders(catalog, "archives")
    assert len([f for f in os.listdir(f"{catalog}/manifest") if f.endswith(".parquet")]) == 1
    assert _seen(spark, catalog) == [("a.zip", "a.mp4"), ("a.zip", "b.mp4")]
    # a failed run leaves a folder without a manifest row
    os.makedirs(f"{catalog}/entries/scan_id=x/run_id=failed")
    assert expire(spark, catalog, dt.timedelta(0)) == ["failed"]


def test_expire_of_an_empty_catalogue(spark, scratch):
    assert expire(spark, f"{scratch}/none", dt.timedelta(0)) == [] == published_runs(spark, f"{scratch}/none")


def test_refresh(spark, scratch):
    catalog, roots = f"{scratch}/catalog", roots_frame(spark, [f"{scratch}/r", f"{scratch}/s"])
    for name in ("grown", "shrunk", "gone", "same", "broken"):
        _zip(f"{scratch}/r/{name}.zip", "a.mp4", "b.mp4")
    _zip(f"{scratch}/s/away.zip", "a.mp4")
    _zip(f"{scratch}/elsewhere/other.zip", "a.mp4")
    scan_and_register(spark, roots_frame(spark, [f"{scratch}/elsewhere"]), catalog, "0", mode="all")
    scan_and_register(spark, roots, catalog, "1", mode="all", refresh=True)
    _zip(f"{scratch}/r/grown.zip", "a.mp4", "b.mp4", "c.mp4")
    _zip(f"{scratch}/r/shrunk.zip", "b.mp4")
    _zip(f"{scratch}/r/new.zip", "n.mp4")
    os.remove(f"{scratch}/r/gone.zip")
    with open(f"{scratch}/r/broken.zip", "w") as fh:
        fh.write("no archive any more")
    os.rename(f"{scratch}/s", f"{scratch}/unmounted")       # nothing is found below it: nothing is retired
    os.makedirs(f"{scratch}/s")
    res = scan_and_register(spark, roots, catalog, "2", mode="all", refresh=True)
    assert sorted(r.archive_name for r in res.listing.collect()) == ["broken.zip", "grown.zip", "new.zip", "shrunk.zip"]
    want = [("away.zip", "a.mp4"), ("grown.zip", "a.mp4"), ("grown.zip", "b.mp4"), ("grown.zip", "c.mp4"),
            ("new.zip", "n.mp4"), ("other.zip", "a.mp4"), ("same.zip", "a.mp4"), ("same.zip", "b.mp4"),
            ("shrunk.zip", "b.mp4")]
    assert _seen(spark, catalog) == want
    res = scan_and_register(spark, roots, catalog, "3", mode="all", refresh=True)
    assert res.listing.count() == 0 and _seen(spark, catalog) == want   # nothing changed, bad archive included
    _zip(f"{scratch}/r/gone.zip", "back.mp4")                # an archive that comes back
    Ledger(spark, catalog, audit=False).scan([f"{scratch}/r"], mode="all", refresh=True, scan_id="4")
    assert ("gone.zip", "back.mp4") in _seen(spark, catalog) and len(_seen(spark, catalog)) == len(want) + 1
    assert list_entries(Catalog.read(spark, catalog)).count() == len(want) + 1


def test_refresh_of_nested_archives(spark, scratch):
    catalog, roots = f"{scratch}/catalog", roots_frame(spark, [f"{scratch}/r"])

    def bundle(*names):
        _zip(f"{scratch}/inner.zip", *names)
        os.makedirs(f"{scratch}/r", exist_ok=True)
        with zipfile.ZipFile(f"{scratch}/r/outer.zip", "w") as zf:
            zf.write(f"{scratch}/inner.zip", "inner.zip")
    bundle("a.mp4", "b.mp4")
    scan_and_register(spark, roots, catalog, "1", mode="all", nested=True, refresh=True)
    assert scan_and_register(spark, roots, catalog, "2", mode="all", nested=True, refresh=True).listing.count() == 0
    assert _seen(spark, catalog) == [("inner.zip", "a.mp4"), ("inner.zip", "b.mp4")]
    bundle("c.mp4")
    scan_and_register(spark, roots, catalog, "3", mode="all", nested=True, refresh=True)
    assert _seen(spark, catalog) == [("inner.zip", "c.mp4")]


def test_source_reads_and_pushes_filters(spark, scratch):
    register_source(spark)
    _zip(f"{scratch}/r/a.zip", "a.mp4", "long-name.mp4")
    _zip(f"{scratch}/r/deep/er/b.ZIP", "b.txt")
    with open(f"{scratch}/r/bad.zip", "w") as fh:
        fh.write("text")
    rows = spark.read.format("archive_entries").option("partitions", 5).load(f"{scratch}/r")
    got = sorted((os.path.basename(r.archive_path), r.entry_ordinal or 0, r.path_in_archive or "", r.error_class or "")
                 for r in rows.collect())
    assert got == [("a.zip", 0, "a.mp4", ""), ("a.zip", 1, "long-name.mp4", ""), ("b.ZIP", 0, "b.txt", ""),
                   ("bad.zip", 0, "", "BadZipFile")]
    some = rows.where("file_size > 5 and path_in_archive like '%.mp4'")
    assert [r.path_in_archive for r in some.collect()] == ["long-name.mp4"]
    assert "PushedFilters: [GreaterThan(file_size,5), StringEndsWith(path_in_archive,.mp4)]" in \
        some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert rows.where("error_class is not null").count() == 1
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW e USING archive_entries OPTIONS (path '{scratch}/r/deep,{scratch}/none')")
    assert spark.sql("SELECT path_in_archive FROM e").collect()[0][0] == "b.txt"


def _caught_up(query, seconds=120):
    end = time.time() + seconds
    while time.time() < end and query.isActive:
        time.sleep(5)
        if query.lastProgress is not None and query.lastProgress["numInputRows"] == 0 and len(query.recentProgress) > 3:
            return
    raise AssertionError(query.exception())


def test_restarted_stream_neither_loses_nor_repeats(spark, scratch):
    register_source(spark)
    folder, out = f"{scratch}/r", f"{scratch}/out"
    names = []
    for k in range(3):
        _zip(f"{folder}/{k}/z{k}.zip", f"{k}.mp4", "x.mp4")
        names += [(f"z{k}.zip", f"{k}.mp4"), (f"z{k}.zip", "x.mp4")]
        if k == 2:
            _zip(f"{folder}/0/z0.zip", "changed.mp4")         # comes again as a whole
            names.append(("z0.zip", "changed.mp4"))
        stream = spark.readStream.format("archive_entries").option("lagSeconds", 0.5).load(folder)
        query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{scratch}/ckpt")
                 .trigger(processingTime="1 second").start())
        try:
            _caught_up(query)
        finally:
            query.stop()
    got = sorted((os.path.basename(r.archive_path), r.path_in_archive) for r in spark.read.parquet(out).collect())
    assert got == sorted(names)


def test_refreshing_stream_equals_batch(spark, scratch):
    folder = f"{scratch}/r"
    _zip(f"{folder}/a.zip", "a.mp4", "b.mp4")
    _zip(f"{folder}/no-targets.zip", "a.txt")
    roots, checkpoint = roots_frame(spark, [folder]), f"{scratch}/ckpt"
    for k in range(2):
        query = watch(spark, folder, f"{scratch}/stream", checkpoint, processing_time="1 second", refresh=True)
        try:
            _caught_up(query)
        finally:
            query.stop()
        scan_and_register(spark, roots, f"{scratch}/batch", f"batch-{k}", mode="all", refresh=True)
        assert _seen(spark, f"{scratch}/stream") == _seen(spark, f"{scratch}/batch")
        progress = [sorted((r.archive_path, r.status) for r in visible(spark, f"{scratch}/{c}", "scan_progress", SCAN_PROGRESS).collect())
                    for c in ("stream", "batch")]
        assert progress[0] == progress[1] and len(progress[0]) == 2 + k
        _zip(f"{folder}/a.zip", "c.mp4")
    # a batch refresh takes over what the stream has read
    assert scan_and_register(spark, roots, f"{scratch}/stream", "later", mode="all", refresh=True).listing.count() == 1
    assert _seen(spark, f"{scratch}/stream") == [("a.zip", "c.mp4")]
