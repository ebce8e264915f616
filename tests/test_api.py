"""The Ledger facade end to end on small takeout drives (F-1, F-7 shapes)."""

import os
import zipfile

import pytest

from zipledger.api import Ledger
from zipledger.functions.ids import archive_uuid_py


def _zip(path, members):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w") as zf:
        for name, data in members:
            zf.writestr(name, data)


def test_ledger_commands(spark, scratch):
    for t in range(2):
        _zip(f"{scratch}/d{t}/GoogleTakeout/takeout_{t}.zip",
             [(f"path/video_{t}_{i}.mp4", b"x" * (10 * (i + 1))) for i in range(5)] + [("path/note.txt", b"n")])
    led = Ledger(spark, f"{scratch}/catalog")
    assert led.stats().collect()[0].zip_files == 0                       # empty catalogue
    res = led.scan([f"{scratch}/d0", f"{scratch}/d1"], drives=["C:", "D:"])
    assert {(r.drive, r.zip_count, r.video_count) for r in res.rollup.collect()} == {("C:", 1, 5), ("D:", 1, 5)}
    s = led.stats().collect()[0]
    assert (s.drives, s.zip_files, s.video_files, s.total_size) == (2, 2, 10, 300)
    assert [r.file_name for r in led.search("VIDEO_1_", limit=2).collect()] == ["video_1_4.mp4", "video_1_3.mp4"]
    assert led.list_videos(limit=3).count() == 3 and led.list_archives().count() == 2
    uuid = archive_uuid_py(f"{scratch}/d0/GoogleTakeout/takeout_0.zip")
    assert led.archive_info(uuid).collect()[0].file_count == 5
    out = f"{scratch}/out"
    one = led.extract("video_0_", out, choice=2).collect()
    assert [(os.path.basename(r.output_path), r.bytes_written) for r in one] == [("video_0_3.mp4", 40)]
    allu = led.extract_by_uuid(uuid, out, choice="all").collect()
    assert len(allu) == 5 and {r.status for r in allu} == {"ok"}
    assert "video_0_3_1.mp4" in {os.path.basename(r.output_path) for r in allu}   # collision with the first run
    _zip(f"{scratch}/many/GoogleTakeout/many.zip", [(f"m{i}.mp4", b"m") for i in range(12)])
    many = Ledger(spark, f"{scratch}/catalog-many")
    many.scan([f"{scratch}/many"], drives=["M:"])
    muuid = archive_uuid_py(f"{scratch}/many/GoogleTakeout/many.zip")
    assert many.extract_by_uuid(muuid, f"{scratch}/out-many", choice="all").count() == 12
    with pytest.raises(ValueError):
        many.extract_by_uuid(muuid, f"{scratch}/out-many", choice="every")
    tally = {r.archive_path: (r.extracted, r.errors) for r in led.extraction_tally(led.extract_all(out)).collect()}
    assert tally[None] == (10, 0)
    assert led.extraction_history().count() == 1 + 5 + 10
    from zipledger.operators.search import F
    rules = led.extract_by_rules([(F.col("file_size") > 30, "large")], f"{scratch}/rules", default="small").collect()
    assert sorted(os.path.relpath(r.output_path, f"{scratch}/rules").split("/")[0] for r in rules) == ["large"] * 4 + ["small"] * 6
    # merge another catalogue: only its new archive is added
    _zip(f"{scratch}/d2/GoogleTakeout/takeout_2.zip", [("v.mp4", b"v")])
    other = Ledger(spark, f"{scratch}/catalog2")
    other.scan([f"{scratch}/d2", f"{scratch}/d0"], drives=["E:", "C:"])
    led.merge([other.path])
    s = led.stats().collect()[0]
    assert (s.zip_files, s.video_files) == (3, 11)
    checks = led.validate(roots=[f"{scratch}/d0", f"{scratch}/d1", f"{scratch}/d2"], drives=["C:", "D:", "E:"])
    assert {k: v.count() for k, v in checks.items()} == {"orphan_entries": 0, "empty_archives": 0,
                                                         "duplicate_paths": 0, "missing_archives": 0,
                                                         "size_drift": 0}
    dups = led.duplicates().collect()
    assert sorted((r.file_size, r.copies, r.archives) for r in dups) == [(10 * (i + 1), 2, 2) for i in range(5)]
    assert led.archive_stats().count() == 3 and led.timeline().count() >= 1
    led.export(led.stats(), f"{scratch}/export", "csv")
    assert os.path.exists(f"{scratch}/export/_SUCCESS")
    _zip(f"{scratch}/d3/GoogleTakeout/late.zip", [("late.mp4", b"late")])
    led.watch(f"{scratch}/d3/GoogleTakeout", f"{scratch}/stream-ckpt").awaitTermination()
    assert led.stats().collect()[0].video_files == 12
    use = {r.op: r.runs for r in led.usage().collect()}
    assert use == {"scan": 1, "search": 1, "extract": 1, "extract_by_uuid": 1, "extract_all": 1, "extract_by_rules": 1, "merge": 1,
                   "watch": 1}
