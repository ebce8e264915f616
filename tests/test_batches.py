"""What a Python worker holds while archives are packed and read: a batch, whatever the size of the input."""

import os
import tracemalloc
import zipfile

import pandas as pd
import pyarrow as pa

from zipledger.sources.packer import _writer
from zipledger.sources.reader import BATCH_ROWS, _read_directories


def test_texts_are_packed_without_copies(scratch):
    texts = [f"{i}-é " + "prose " * 30000 for i in range(120)]   # 21 MB
    paths = [f"/mnt/c/{i // 50}.zip" for i in range(120)]
    batches = [pa.record_batch({"archive_path": paths[a:a + 60], "path_in_archive": [f"en/{i}.mp4" for i in range(a, a + 60)],
                                "doc_id": list(range(a, a + 60)), "text": texts[a:a + 60]}) for a in (0, 60)]
    tracemalloc.start()
    out = [r for b in _writer(scratch)(iter(batches)) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    assert out == [{"archive_path": f"/mnt/c/{k}.zip", "entries": n} for k, n in enumerate((50, 50, 20))]
    for k in range(3):
        with zipfile.ZipFile(f"{scratch}/mnt/c/{k}.zip") as zf:
            assert [zf.read(i).decode() for i in zf.infolist()] == texts[50 * k:50 * k + 50]
            assert zf.infolist()[0].file_size == len(texts[50 * k].encode()) and zf.testzip() is None
    assert sorted(os.listdir(f"{scratch}/mnt/c")) == ["0.zip", "1.zip", "2.zip"]


def test_directories_come_in_small_batches(scratch):
    with zipfile.ZipFile(f"{scratch}/a.zip", "w") as zf:
        for i in range(4500):
            zf.writestr(f"{i}.mp4", b"")
    listing = pd.DataFrame({"archive_path": [f"{scratch}/a.zip"], "drive": ["D:"]})
    sizes = [len(b) for b in _read_directories(BATCH_ROWS)(iter([listing]))]
    assert sum(sizes) == 4500 and max(sizes) <= 2000


def test_packing_tasks_follow_from_the_bytes(spark, scratch, monkeypatch):
    from zipledger.sources import packer
    from zipledger.sources.fs import size_of
    sf, asked = "/root/testdata/sf0.001", []
    monkeypatch.setattr(packer, "task_count", lambda spark, amount, each: asked.append((amount, each)) or 3, raising=False)
    packer.pack_documents(spark, sf, f"{scratch}/base")
    assert asked == [(size_of(f"{sf}/documents.parquet", spark), packer.PACK_BYTES)]
    packed = [f"{d}/{n}" for d, _, names in os.walk(f"{scratch}/base/mnt") for n in names if not n.endswith("-index.zip")]
    assert sum(len(zipfile.ZipFile(p).infolist()) for p in packed) == spark.read.parquet(f"{sf}/documents.parquet").count()
