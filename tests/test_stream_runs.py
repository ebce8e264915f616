"""Streams over many micro-batches: what a batch costs does not grow, and no archive is registered twice."""

import datetime as dt
import os
import zipfile

from pyspark.sql import functions as F

from zipledger.plans.scan import scan_and_register
from zipledger.schemas import ARCHIVE_TOTALS, SCAN_ERRORS, SCAN_PROGRESS
from zipledger.sources.catalog import Catalog, visible
from zipledger.sources.listing import roots_frame
from zipledger.streaming import watch as W

TS = dt.datetime(2024, 1, 2, 3, 4, 5)


def _zip(path, members):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w") as zf:
        for name, data in members:
            zf.writestr(name, data)


def test_earlier_runs_are_read_once(spark, scratch, monkeypatch):
    calls, visible_of = [], W.visible
    monkeypatch.setattr(W, "visible", lambda *a, **k: calls.append(a) or visible_of(*a, **k))
    monkeypatch.setattr(W, "MERGE_RUNS", 2, raising=False)
    for i in range(5):
        _zip(f"{scratch}/a/{i}.zip", [("x.mp4", b"x" * i), ("y.mp4", b"yy"), ("z.txt", b"z")])
    _zip(f"{scratch}/a/none.zip", [])
    _zip(f"{scratch}/a/text.zip", [("z.txt", b"z")])
    with open(f"{scratch}/a/bad.zip", "w") as fh:
        fh.write("broken")
    cat = f"{scratch}/catalog"
    W.watch(spark, f"{scratch}/a", cat, f"{scratch}/ckpt", scan_ts=TS, max_files_per_trigger=1).awaitTermination()
    assert len(calls) == 1   # eight batches
    c = Catalog.read(spark, cat)
    assert sorted(r.archive_name for r in c.archives.collect()) == [f"{i}.zip" for i in range(5)]
    assert c.entries.count() == 10
    totals = visible(spark, cat, "archive_totals", ARCHIVE_TOTALS).collect()
    assert sorted((r.entries, r.total_size, r.min_size, r.max_size) for r in totals) == [
        (2, 2 + i, min(i, 2), max(i, 2)) for i in range(5)]
    status = {os.path.basename(r.archive_path): r.status for r in visible(spark, cat, "scan_progress", SCAN_PROGRESS).collect()}
    assert status == {**{f"{i}.zip": "done" for i in range(5)}, "none.zip": "no_targets", "text.zip": "no_targets",
                      "bad.zip": "error"}
    assert [r.error_class for r in visible(spark, cat, "scan_errors", SCAN_ERRORS).collect()] == ["BadZipFile"]


def test_runs_of_others_and_replays(spark, scratch, monkeypatch):
    monkeypatch.setattr(W, "MERGE_RUNS", 1, raising=False)
    for name in "abcde":
        _zip(f"{scratch}/r/GoogleTakeout/{name}.zip", [(f"{name}.mp4", name.encode())])
    files = (spark.read.format("binaryFile").load(f"{scratch}/r/GoogleTakeout")
             .select("path", "length", "modificationTime"))
    batch = lambda names: files.filter(F.regexp_extract("path", r"(.)\.zip$", 1).isin(list(names)))
    cat = f"{scratch}/catalog"
    write = W._batch_writer(cat, False, lambda c: F.lit("S:"), TS, "s")
    write(batch("a"), 0)
    write(batch("b"), 1)
    scan_and_register(spark, roots_frame(spark, [f"{scratch}/r"], ["R:"]), cat, "other", scan_ts=TS)   # takes the rest
    write(batch("abc"), 2)     # all registered: by this stream's runs and by the other scan
    write(batch("b"), 1)       # delivered again after its run was put together with others
    W._batch_writer(cat, False, lambda c: F.lit("S:"), TS, "s")(batch("b"), 1)   # and after a restart
    rows = Catalog.read(spark, cat).archives.select("archive_name", "scan_id").collect()
    assert sorted((r.archive_name, r.scan_id) for r in rows) == [
        ("a.zip", "stream-s-000000"), ("b.zip", "stream-s-000001"), ("c.zip", "other"), ("d.zip", "other"), ("e.zip", "other")]
