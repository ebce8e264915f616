"""Listing, reading, registering, merging and extracting real archives.

Fixtures F-1 .. F-10 of FIXTURES.md, with the Python standard library
(``os.walk``, ``zipfile``) as the oracle for listing and reading.
"""

import datetime as dt
import hashlib
import os
import zipfile

from pyspark.sql import functions as F

from zipledger.functions.paths import EXCLUDED_DIRECTORIES
from zipledger.operators import extract as X
from zipledger.operators import search as S
from zipledger.operators.merge import merge_paths
from zipledger.operators.stats import list_archives, summary
from zipledger.plans.scan import labelled, list_roots, scan, scan_and_register
from zipledger.schemas import SCAN_ERRORS, SCAN_PROGRESS
from zipledger.sources.catalog import Catalog, visible
from zipledger.sources.listing import roots_frame

TS = dt.datetime(2024, 5, 1)


def _zip(path, members):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w") as zf:
        for name, data in members:
            zf.writestr(name, data)


def _f10(root):
    _zip(f"{root}/a b.zip", [("d/", b""), ("d/q.MOV", b"q" * 10), ("x.mp4", b"1"), ("x.mp4", b"22"),
                             ("ü/é.mkv", b"e" * 5), ("readme.txt", b"r")])
    _zip(f"{root}/_u.zip", [("u.avi", b"u")])
    _zip(f"{root}/.h/z.zip", [("z.webm", b"z")])
    _zip(f"{root}/sub/C.ZIP", [("c.mpg", b"c")])
    _zip(f"{root}/p%20q.zip", [("p.mp4", b"p")])
    _zip(f"{root}/node_modules/n.zip", [("n.mp4", b"n")])
    _zip(f"{root}/.git/g.zip", [("g.mp4", b"g")])
    _zip(f"{root}/Windows/w.zip", [("w.mp4", b"w")])
    _zip(f"{root}/dir.zip/inner.zip", [("i.mp4", b"i")])
    with open(f"{root}/bad.zip", "w") as fh:
        fh.write("not a zip")
    os.symlink(f"{root}/sub", f"{root}/link")


def _walk_oracle(root, excluded=EXCLUDED_DIRECTORIES):
    out = []
    for d, dirs, files in os.walk(root):
        dirs[:] = [x for x in dirs if x not in set(excluded)]
        out += [os.path.join(d, f) for f in files if f.lower().endswith(".zip")]
    return sorted(out)


def test_f10_listing_all_mode(spark, scratch):
    _f10(scratch)
    listing, _ = list_roots(spark, roots_frame(spark, [scratch], ["R:"]), mode="all")
    got = sorted(r.archive_path for r in listing.collect())
    assert got == _walk_oracle(scratch)
    assert f"{scratch}/link/C.ZIP" not in got and f"{scratch}/.h/z.zip" in got


def test_f10_reading_and_errors(spark, scratch):
    _f10(scratch)
    roots = roots_frame(spark, [scratch], ["R:"])
    res = scan(spark, roots, mode="all", all_files=False, scan_ts=TS)
    ent = {(r.archive_path.rsplit("/", 1)[1], r.path_in_archive, r.entry_ordinal, r.file_size)
           for r in res.entries.collect()}
    want = set()
    for path in _walk_oracle(scratch):
        try:
            with zipfile.ZipFile(path) as zf:
                for i, info in enumerate(zf.infolist()):
                    ext = os.path.splitext(info.filename.lower())[1]
                    if not info.is_dir() and ext in (".mov", ".mp4", ".mkv", ".avi", ".webm", ".mpg"):
                        want.add((path.rsplit("/", 1)[1], info.filename, i, info.file_size))
        except zipfile.BadZipFile:
            pass
    assert ent == want
    # duplicates are kept, the directory entry and the .txt are not catalogued
    assert ("a b.zip", "x.mp4", 2, 1) in ent and ("a b.zip", "x.mp4", 3, 2) in ent
    errs = res.errors.collect()
    assert [(e.archive_path, e.error_class) for e in errs] == [(f"{scratch}/bad.zip", "BadZipFile")]


def test_f3_text_file_named_zip(spark, scratch):
    os.makedirs(f"{scratch}/GoogleTakeout")
    with open(f"{scratch}/GoogleTakeout/fake.zip", "w") as fh:
        fh.write("this is not a zip file")
    res = scan(spark, roots_frame(spark, [scratch], ["T:"]), mode="takeout", scan_ts=TS)
    assert res.entries.count() == 0 and res.archives.count() == 0
    assert res.errors.count() == 1
    roll = res.rollup.collect()
    assert [(r.drive, r.zip_count, r.video_count, r.success) for r in roll] == [("T:", 0, 0, True)]


def test_f7_takeout_end_to_end(spark, scratch):
    _zip(f"{scratch}/GoogleTakeout/test_archive.zip", [("path/test_video.mp4", b"v" * 100)])
    _zip(f"{scratch}/GoogleTakeout/nested/deeper.zip", [("x.mp4", b"x")])   # not a direct child
    _zip(f"{scratch}/other/elsewhere.zip", [("y.mp4", b"y")])               # not in the takeout folder
    os.makedirs(f"{scratch}/googletakeout2")
    res = scan(spark, roots_frame(spark, [scratch], ["G:"]), mode="takeout", scan_ts=TS)
    assert [(r.archive_name, r.drive) for r in res.archives.collect()] == [("test_archive.zip", "G:")]
    assert [(r.file_name, r.file_size) for r in res.entries.collect()] == [("test_video.mp4", 100)]


def test_f1_register_and_rerun_is_idempotent(spark, scratch):
    root = f"{scratch}/drives"
    for t in range(4):
        _zip(f"{root}/d{t}/GoogleTakeout/thread_{t}.zip",
             [(f"path/video_{t}_{i}.mp4", b"x" * (i + 1)) for i in range(5)])
    roots = roots_frame(spark, [f"{root}/d{t}" for t in range(4)], [f"Drive{t}" for t in range(4)])
    cat_path = f"{scratch}/catalog"
    for _ in range(2):  # a rerun of the same scan id replaces its own partition only
        scan_and_register(spark, roots, cat_path, "s1", scan_ts=TS)
    s = summary(Catalog.read(spark, cat_path)).collect()[0]
    assert (s.zip_files, s.video_files, s.drives) == (4, 20, 4)


def test_half_written_scan_is_invisible(spark, scratch):
    cat_path = f"{scratch}/catalog"
    _zip(f"{scratch}/r/GoogleTakeout/a.zip", [("a.mp4", b"a")])
    scan_and_register(spark, roots_frame(spark, [f"{scratch}/r"], ["A:"]), cat_path, "s1", scan_ts=TS)
    c = Catalog.read(spark, cat_path)
    # entries of a scan whose archives were never committed
    orphan = c.entries.withColumn("archive_uuid", F.lit("x")).withColumn("scan_id", F.lit("s2"))
    orphan.write.mode("append").partitionBy("scan_id", "run_id").parquet(f"{cat_path}/entries")
    assert Catalog.read(spark, cat_path).entries.count() == 1


def _source_catalog(spark, scratch, i, n_entries, name_fmt, size_mib):
    root = f"{scratch}/src{i}"
    _zip(f"{root}/GoogleTakeout/source_{i}.zip",
         [(f"folder/{name_fmt.format(i=i, j=j)}", b"v" * (j + 1)) for j in range(n_entries)])
    path = f"{scratch}/cat{i}"
    scan_and_register(spark, roots_frame(spark, [root], [f"Source{i}"]), path, f"s{i}", scan_ts=TS)
    return path


def test_f2_merge_three_sources(spark, scratch):
    paths = [_source_catalog(spark, scratch, i, 3, "video_src{i}_{j}.mp4", 10) for i in range(3)]
    merged = merge_paths(spark, paths + [f"{scratch}/missing"])   # a missing source is skipped
    assert merged.archives.count() == 3 and merged.entries.count() == 9


def test_f6_merge_twenty_sources_with_overlap(spark, scratch):
    paths = [_source_catalog(spark, scratch, i, 2, "stress_{i}_video_{j}.mp4", 5) for i in range(20)]
    merged = merge_paths(spark, paths + paths[:5])   # repeated sources: first wins, no duplicates
    assert merged.archives.count() == 20 and merged.entries.count() == 40
    assert {r.source_ord for r in merged.archives.collect()} == set(range(20))


def test_f4_search_wildcard_underscore(spark, scratch):
    root = f"{scratch}/big"
    _zip(f"{root}/GoogleTakeout/large_archive.zip",
         [(f"year_2023/month_{i // 100}/video_{i:06d}.mp4", b"") for i in range(1000)])
    cat_path = f"{scratch}/catalog"
    scan_and_register(spark, roots_frame(spark, [root], ["LargeTest"]), cat_path, "s1", scan_ts=TS)
    c = Catalog.read(spark, cat_path)
    assert S.search(c, "video_000").count() == 1000   # '_' is a wildcard
    assert S.search(c, "VIDEO_0001").count() == 100


def test_extraction_names_errors_and_bytes(spark, scratch):
    root = f"{scratch}/r"
    data = {"a/x.mp4": b"first", "b/x.mp4": b"second", "c/y.mp4": b"third"}
    _zip(f"{root}/GoogleTakeout/e.zip", list(data.items()))
    cat_path = f"{scratch}/catalog"
    scan_and_register(spark, roots_frame(spark, [root], ["E:"]), cat_path, "s1", scan_ts=TS)
    c = Catalog.read(spark, cat_path)
    out = f"{scratch}/out"
    os.makedirs(out)
    with open(f"{out}/x.mp4", "wb") as fh:     # an existing file takes the first name
        fh.write(b"old")
    m = S.matched(c, F.lit(True))
    res = X.extract(m, [F.col("path_in_archive")], out)
    rows = {r.path_in_archive: r for r in res.collect()}
    assert os.path.basename(rows["a/x.mp4"].output_path) == "x_1.mp4"
    assert os.path.basename(rows["b/x.mp4"].output_path) == "x_2.mp4"
    assert os.path.basename(rows["c/y.mp4"].output_path) == "y.mp4"
    for member, payload in data.items():
        r = rows[member]
        assert r.status == "ok" and r.bytes_written == len(payload)
        assert r.sha256 == hashlib.sha256(payload).hexdigest()
        with open(r.output_path, "rb") as fh:
            assert fh.read() == payload
    with open(f"{out}/x.mp4", "rb") as fh:
        assert fh.read() == b"old"
    # an entry missing from the archive is reported, not fatal
    ghost = spark.createDataFrame([(f"{root}/GoogleTakeout/e.zip", "zz/none.mp4", "none.mp4", 1, 9)],
                                  "archive_path string, path_in_archive string, file_name string, "
                                  "file_size long, entry_ordinal int")
    res2 = X.extract(ghost, [F.col("path_in_archive")], out).collect()
    assert [(r.status, r.bytes_written) for r in res2] == [("missing", None)]


def test_first_registration_wins_and_resolve(spark, scratch):
    cat_path = f"{scratch}/catalog"
    _zip(f"{scratch}/r/GoogleTakeout/a.zip", [("a.mp4", b"a"), ("b.mp4", b"bb")])
    roots = roots_frame(spark, [f"{scratch}/r"], ["A:"])
    scan_and_register(spark, roots, cat_path, "s1", scan_ts=TS, scan_seq=1)
    scan_and_register(spark, roots, cat_path, "s2", scan_ts=TS, scan_seq=2)   # same path again
    c = Catalog.read(spark, cat_path)
    assert [r.scan_id for r in c.archives.collect()] == ["s1"] and c.entries.count() == 2
    # a duplicate registration copied in by other means is resolved on request
    c.archives.withColumn("scan_id", F.lit("s3")).withColumn("scan_seq", F.lit(0).cast("long")) \
        .write.mode("append").partitionBy("scan_id", "run_id").parquet(f"{cat_path}/archives")
    c.entries.drop("scan_id").withColumn("scan_id", F.lit("s3")) \
        .write.mode("append").partitionBy("scan_id", "run_id").parquet(f"{cat_path}/entries")
    manifest = spark.read.parquet(f"{cat_path}/manifest")
    (manifest.filter("scan_id = 's1'").withColumn("scan_id", F.lit("s3"))
     .write.mode("append").parquet(f"{cat_path}/manifest"))
    assert Catalog.read(spark, cat_path).archives.count() == 2
    r = Catalog.read(spark, cat_path, resolve=True)
    assert [x.scan_id for x in r.archives.collect()] == ["s3"] and r.entries.count() == 2
    r2 = Catalog.read(spark, cat_path, refresh=True)
    assert [x.scan_id for x in r2.archives.collect()] == ["s1"]


def test_integrity_check_finds_corrupt_entry(spark, scratch):
    from zipledger.operators.analytics import integrity_check
    from zipledger.sources.reader import read_central_directories
    good, broken = f"{scratch}/r/GoogleTakeout/good.zip", f"{scratch}/r/GoogleTakeout/broken.zip"
    os.makedirs(os.path.dirname(good), exist_ok=True)
    for p in (good, broken):
        with zipfile.ZipFile(p, "w", compression=zipfile.ZIP_STORED) as zf:
            zf.writestr("a.mp4", b"A" * 1000)
            zf.writestr("b.mp4", b"B" * 1000)
    with zipfile.ZipFile(broken) as zf:
        off = zf.getinfo("b.mp4").header_offset + 30 + len("b.mp4") + 10   # inside b.mp4's data
    with open(broken, "r+b") as fh:
        fh.seek(off)
        fh.write(b"X")
    listing = spark.createDataFrame([(good, "R:"), (broken, "R:")], "archive_path string, drive string")
    got = {r.archive_path.rsplit("/", 1)[1]: (r.status, r.checked, r.first_bad)
           for r in integrity_check(read_central_directories(listing)).collect()}
    assert got == {"good.zip": ("ok", 2, None), "broken.zip": ("corrupt", 2, 1)}


def test_f5_snapshot_reads_during_appends(spark, scratch):
    cat_path = f"{scratch}/catalog"
    _zip(f"{scratch}/r0/GoogleTakeout/initial.zip", [(f"video_{i}.mp4", b"v" * 25) for i in range(10)])
    scan_and_register(spark, roots_frame(spark, [f"{scratch}/r0"], ["W:"]), cat_path, "s0", scan_ts=TS)
    first = Catalog.read(spark, cat_path)
    assert first.entries.count() == 10
    for b in range(1, 6):
        _zip(f"{scratch}/r{b}/GoogleTakeout/append_{b}.zip",
             [(f"writer_video_{b}_{j}.mp4", b"w" * 15) for j in range(3)])
        scan_and_register(spark, roots_frame(spark, [f"{scratch}/r{b}"], ["W:"]), cat_path, f"s{b}", scan_ts=TS)
        assert Catalog.read(spark, cat_path).entries.count() == 10 + 3 * b
    assert first.entries.count() == 10          # a reader keeps the snapshot it opened
    assert summary(Catalog.read(spark, cat_path)).collect()[0].video_files == 25


def test_stream_batch_replay_is_idempotent(spark, scratch):
    from zipledger.streaming.watch import _batch_writer
    _zip(f"{scratch}/r/GoogleTakeout/a.zip", [("a.mp4", b"a"), ("b.mp4", b"b")])
    _zip(f"{scratch}/r/GoogleTakeout/c.zip", [("c.mp4", b"c")])
    batch = (spark.read.format("binaryFile").load(f"{scratch}/r/GoogleTakeout")
             .select("path", "length", "modificationTime"))
    write = _batch_writer(f"{scratch}/catalog", False, lambda c: F.lit("S:"), TS)
    for _ in range(2):                            # the same micro-batch delivered twice
        write(batch, 7)
    c = Catalog.read(spark, f"{scratch}/catalog")
    assert c.archives.count() == 2 and c.entries.count() == 3


def test_walk_follow_symlinks_option(spark, scratch):
    from zipledger.sources.listing import list_all
    _f10(scratch)
    roots = roots_frame(spark, [scratch], ["R:"])
    got = {r.archive_path for r in list_all(spark, roots, follow_symlinks=True).collect()}
    assert f"{scratch}/link/C.ZIP" in got and f"{scratch}/sub/C.ZIP" in got
    assert f"{scratch}/.git/g.zip" not in got            # exclusions still apply
    assert len(list_all(spark, roots, excluded=()).collect()) == len(_walk_oracle(scratch, excluded=()))


def test_compression_ratio_filter(spark, scratch):
    from zipledger.operators.analytics import filter_ratio
    path = f"{scratch}/r/GoogleTakeout/mixed.zip"
    os.makedirs(os.path.dirname(path))
    with zipfile.ZipFile(path, "w") as zf:
        zf.writestr(zipfile.ZipInfo("flat.mp4"), os.urandom(4000), compress_type=zipfile.ZIP_STORED)
        zf.writestr(zipfile.ZipInfo("text.mp4"), b"a" * 4000, compress_type=zipfile.ZIP_DEFLATED)
    res = scan(spark, roots_frame(spark, [f"{scratch}/r"], ["M:"]), mode="takeout", scan_ts=TS)
    assert [r.file_name for r in filter_ratio(res.entries, 0.5).collect()] == ["text.mp4"]
    assert res.entries.count() == 2


def test_nested_archives_one_level(spark, scratch):
    import io
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", compression=zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("clip.mp4", b"c" * 50)
        zf.writestr("photo.jpg", b"p")
    outer = f"{scratch}/r/bundle.zip"
    os.makedirs(os.path.dirname(outer))
    with zipfile.ZipFile(outer, "w", compression=zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("a/inner.zip", inner.getvalue())       # deflated inner archive
        zf.writestr("b/fake.ZIP", b"not a zip")             # named .zip, not an archive
        zf.writestr("top.mp4", b"t" * 5)
    cat_path = f"{scratch}/catalog"
    res = scan_and_register(spark, roots_frame(spark, [f"{scratch}/r"], ["N:"]), cat_path, "s1",
                            mode="all", nested=True, scan_ts=TS)
    got = sorted((r.archive_path.replace(scratch, ""), r.file_name, r.file_size) for r in res.entries.collect())
    assert got == [("/r/bundle.zip", "top.mp4", 5), ("/r/bundle.zip!/a/inner.zip", "clip.mp4", 50)]
    errs = [(e.archive_path.replace(scratch, ""), e.error_class) for e in res.errors.collect()]
    assert errs == [("/r/bundle.zip!/b/fake.ZIP", "BadZipFile")]
    c = Catalog.read(spark, cat_path)
    names = sorted((r.archive_name, r.file_count) for r in list_archives(c).collect())
    assert names == [("bundle.zip", 1), ("inner.zip", 1)]


def test_follow_symlinks_survives_a_cycle(spark, scratch):
    from zipledger.sources.listing import list_all
    _zip(f"{scratch}/r/a/x.zip", [("x.mp4", b"x")])
    os.symlink(f"{scratch}/r", f"{scratch}/r/a/loop")          # r/a/loop -> r  (a cycle)
    os.symlink(f"{scratch}/r/a", f"{scratch}/r/alias")         # a second way into r/a
    roots = roots_frame(spark, [f"{scratch}/r"], ["L:"])
    got = sorted(r.archive_path.replace(scratch, "") for r in list_all(spark, roots, follow_symlinks=True).collect())
    assert got == ["/r/a/x.zip", "/r/alias/x.zip"]   # every alias is visited, the cycle is not followed


def test_nested_to_any_depth_with_duplicate_names(spark, scratch):
    import io

    def packed(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", compression=zipfile.ZIP_DEFLATED) as zf:
            for name, data in members:
                zf.writestr(name, data)
        return out.getvalue()

    deep = packed([("deep.mp4", b"deep!")])
    members = [("i.zip", packed([("first.mp4", b"1")])), ("i.zip", packed([("second.mp4", b"22"), ("in/d.zip", deep)]))]
    os.makedirs(f"{scratch}/r")
    with open(f"{scratch}/r/o.zip", "wb") as fh:
        fh.write(packed(members))
    cat_path = f"{scratch}/catalog"
    scan_and_register(spark, roots_frame(spark, [f"{scratch}/r"], ["N:"]), cat_path, "s1", mode="all", nested=True,
                      scan_ts=TS)
    c = Catalog.read(spark, cat_path)
    rows = S.matched(c, F.lit(True)).collect()
    assert sorted((r.archive_path.replace(scratch, ""), r.file_name) for r in rows) == [
        ("/r/o.zip!/i.zip", "first.mp4"), ("/r/o.zip!1/i.zip", "second.mp4"), ("/r/o.zip!1/i.zip!/in/d.zip", "deep.mp4")]
    res = X.extract(S.matched(c, F.lit(True)), S.size_desc(), f"file:{scratch}/out").collect()
    assert {r.path_in_archive: (r.status, r.bytes_written) for r in res} == {
        "first.mp4": ("ok", 1), "second.mp4": ("ok", 2), "deep.mp4": ("ok", 5)}
    assert sorted(os.listdir(f"{scratch}/out")) == ["deep.mp4", "first.mp4", "second.mp4"]


def test_entries_of_one_name_keep_their_bytes(spark, scratch):
    _zip(f"{scratch}/r/GoogleTakeout/d.zip", [("x.mp4", b"one"), ("x.mp4", b"three"), ("y.mp4", b"y")])
    cat_path = f"{scratch}/catalog"
    scan_and_register(spark, roots_frame(spark, [f"{scratch}/r"], ["D:"]), cat_path, "s1", scan_ts=TS)
    m = S.matched(Catalog.read(spark, cat_path), F.lit(True))
    res = X.extract(m, S.size_desc(), f"{scratch}/out")
    assert {(r.entry_ordinal, r.bytes_written) for r in res.collect()} == {(0, 3), (1, 5), (2, 1)}
    expected = m.select("archive_path", "path_in_archive", "entry_ordinal", "file_size").withColumn(
        "file_hash", F.lit(None).cast("string"))
    assert [r.verdict for r in X.validate(res, expected).collect()] == ["valid"] * 3
    one = X.extract(m.filter("entry_ordinal = 0"), S.size_desc(), f"{scratch}/out2")
    assert sorted(r.entry_ordinal for r in X.remaining(m, one).collect()) == [1, 2]


def test_extraction_never_replaces_a_foreign_file(spark, scratch):
    _zip(f"{scratch}/r/GoogleTakeout/d.zip", [("x.mp4", b"new")])
    scan_and_register(spark, roots_frame(spark, [f"{scratch}/r"], ["D:"]), f"{scratch}/c", "s1", scan_ts=TS)
    planned = X.plan(S.matched(Catalog.read(spark, f"{scratch}/c"), F.lit(True)), S.size_desc(), f"{scratch}/out")
    os.makedirs(f"{scratch}/out")
    with open(f"{scratch}/out/x.mp4", "w") as fh:      # taken after the plan was made
        fh.write("mine")
    assert [r.status for r in X.run(planned).collect()] == ["error"]
    with open(f"{scratch}/out/x.mp4") as fh:
        assert fh.read() == "mine"
    assert os.listdir(f"{scratch}/out") == ["x.mp4"]


def test_empty_scans_and_reruns(spark, scratch):
    cat_path = f"{scratch}/catalog"
    os.makedirs(f"{scratch}/r/GoogleTakeout")
    roots = roots_frame(spark, [f"{scratch}/r"], ["A:"])
    scan_and_register(spark, roots, cat_path, "s1", scan_ts=TS)          # nothing there yet
    assert Catalog.read(spark, cat_path).archives.count() == 0
    with open(f"{scratch}/r/GoogleTakeout/a.zip", "w") as fh:
        fh.write("broken")
    _zip(f"{scratch}/r/GoogleTakeout/b.zip", [("b.mp4", b"b")])
    scan_and_register(spark, roots, cat_path, "s1", scan_ts=TS)
    errors = lambda: visible(spark, cat_path, "scan_errors", SCAN_ERRORS).count()
    assert errors() == 1 and Catalog.read(spark, cat_path).entries.count() == 1
    _zip(f"{scratch}/r/GoogleTakeout/a.zip", [("a.mp4", b"a")])
    scan_and_register(spark, roots, cat_path, "s1", scan_ts=TS)          # mended: the error goes
    assert errors() == 0 and Catalog.read(spark, cat_path).archives.count() == 2
    progress = visible(spark, cat_path, "scan_progress", SCAN_PROGRESS)
    assert {r.status for r in progress.collect()} == {"done"} and progress.count() == 2
    os.remove(f"{scratch}/r/GoogleTakeout/a.zip")
    os.remove(f"{scratch}/r/GoogleTakeout/b.zip")
    scan_and_register(spark, roots, cat_path, "s1", scan_ts=TS)          # all gone
    assert Catalog.read(spark, cat_path).archives.count() == 0


def test_resume_skips_unchanged_bad_archives(spark, scratch):
    cat_path = f"{scratch}/catalog"
    _zip(f"{scratch}/r/GoogleTakeout/none.zip", [("readme.txt", b"t")])
    with open(f"{scratch}/r/GoogleTakeout/bad.zip", "w") as fh:
        fh.write("broken")
    roots = roots_frame(spark, [f"{scratch}/r"], ["A:"])
    scan_and_register(spark, roots, cat_path, "s1", scan_ts=TS)
    assert scan_and_register(spark, roots, cat_path, "s2", resume=True, scan_ts=TS).listing.count() == 0
    _zip(f"{scratch}/r/GoogleTakeout/none.zip", [("readme.txt", b"t"), ("v.mp4", b"v")])
    again = scan_and_register(spark, roots, cat_path, "s3", resume=True, scan_ts=TS)
    assert [r.archive_name for r in again.listing.collect()] == ["none.zip"] and again.entries.count() == 1


def test_two_streams_share_a_catalogue(spark, scratch):
    from zipledger.streaming.watch import watch
    _zip(f"{scratch}/a/x.zip", [("x.mp4", b"x")])
    _zip(f"{scratch}/a/no-targets.zip", [("x.txt", b"x")])
    _zip(f"{scratch}/b/y.zip", [("y.mp4", b"y")])
    for name in "ab":
        watch(spark, f"{scratch}/{name}", f"{scratch}/catalog", f"{scratch}/ckpt-{name}", scan_ts=TS,
              max_files_per_trigger=1).awaitTermination()
    names = sorted(r.archive_name for r in Catalog.read(spark, f"{scratch}/catalog").archives.collect())
    assert names == ["x.zip", "y.zip"]


def test_archives_take_the_label_of_their_own_path(spark, scratch):
    rows = [("/mnt/c/Takeout/a.zip", None), ("/mnt/d/b.zip", None), ("/data/x.zip", "Z:")]
    listing = spark.createDataFrame(rows, "archive_path string, drive string")
    assert [r.drive for r in labelled(listing, "wsl").collect()] == ["C:", "D:", "Z:"]
    assert [r.drive for r in labelled(listing, "posix").collect()] == ["mnt", "mnt", "Z:"]
    _zip(f"{scratch}/r/a.zip", [("a.mp4", b"a")])
    res = scan(spark, roots_frame(spark, [f"{scratch}/r"]), mode="all", scan_ts=TS)
    assert [r.drive for r in res.rollup.collect()] == [scratch.split("/")[1]]


def test_object_listing_extensions_and_links(spark, scratch):
    _f10(scratch)
    objects = scan(spark, roots_frame(spark, [scratch], ["O:"]), mode="objects", extensions=[".TXT"], scan_ts=TS)
    assert {r.drive for r in objects.listing.collect()} == {"O:"}
    assert {r.file_name.rsplit(".", 1)[1] for r in objects.entries.collect()} <= {"txt"}
    linked = scan(spark, roots_frame(spark, [scratch], ["R:"]), mode="all", follow_symlinks=True, scan_ts=TS)
    assert f"{scratch}/link/C.ZIP" in {r.archive_path for r in linked.listing.collect()}


def test_compare_by_checksum_and_repeated_paths(spark):
    from zipledger.operators.analytics import compare
    schema = "path_in_archive string, entry_ordinal int, file_size long, crc32 long"
    left = spark.createDataFrame([("a", 0, 4, 1), ("b", 1, 4, 2), ("b", 2, 5, 3), ("c", 3, 1, 4)], schema)
    right = spark.createDataFrame([("a", 0, 4, 9), ("b", 1, 4, 2), ("b", 2, 5, 3), ("d", 3, 1, 4)], schema)
    got = sorted((r.path_in_archive, r.status) for r in compare(left, right).collect())
    assert got == [("a", "changed"), ("b", "same"), ("b", "same"), ("c", "removed"), ("d", "added")]


def test_unreadable_candidates_are_reported(spark, scratch):
    from zipledger.operators.analytics import search_text
    from zipledger.operators.quality import duplicates_by_content
    for name in "ab":
        _zip(f"{scratch}/r/GoogleTakeout/{name}.zip", [("t.txt", b"same text")])
    scan_and_register(spark, roots_frame(spark, [f"{scratch}/r"], ["A:"]), f"{scratch}/c", "s1", all_files=True,
                      scan_ts=TS)
    c = Catalog.read(spark, f"{scratch}/c")
    assert duplicates_by_content(c).count() == 1 and search_text(c, "same").count() == 2
    os.rename(f"{scratch}/r/GoogleTakeout/b.zip", f"{scratch}/r/b.away")
    assert duplicates_by_content(c).count() == 0 and duplicates_by_content(c, errors=True).count() == 1
    assert search_text(c, "same").count() == 1 and search_text(c, "same", errors=True).count() == 1
