"""Merge rules on hand-built catalogues (paths and uuids unique, first source wins)."""

import datetime as dt

from zipledger.operators.merge import merge
from zipledger.sources.catalog import ARCHIVE_COLS, ENTRY_COLS, Catalog
from zipledger.schemas import ARCHIVES, ENTRIES

TS = dt.datetime(2024, 1, 1)


def _cat(spark, archives, entries):
    a = [(u, "D:", p.rsplit("/", 1)[1], p, 1, None, None, TS, 0) for u, p in archives]
    e = [(u, n, 1, n, i, None, TS, None, None, None, None, None) for i, (u, n) in enumerate(entries)]
    return Catalog(spark.createDataFrame(a, ARCHIVES), spark.createDataFrame(e, ENTRIES))


def test_merge_paths_and_uuids_unique(spark):
    s0 = _cat(spark, [("u1", "/a.zip"), ("u2", "/b.zip")], [("u1", "a1"), ("u2", "b1"), ("u2", "b2")])
    s1 = _cat(spark, [("u3", "/a.zip"), ("u2", "/c.zip"), ("u4", "/d.zip")],
              [("u3", "a9"), ("u2", "c1"), ("u4", "d1")])
    m = merge([s0, s1])
    arch = sorted((r.archive_path, r.archive_uuid, r.source_ord) for r in m.archives.collect())
    # /a.zip kept from source 0; /c.zip loses uuid u2 to /b.zip (source 0); /d.zip is new
    assert arch == [("/a.zip", "u1", 0), ("/b.zip", "u2", 0), ("/d.zip", "u4", 1)]
    ent = sorted((r.archive_uuid, r.file_name) for r in m.entries.collect())
    assert ent == [("u1", "a1"), ("u2", "b1"), ("u2", "b2"), ("u4", "d1")]   # no orphans, no copies
    assert set(m.archives.columns) == set(ARCHIVE_COLS + ["source_ord"])
    assert set(ENTRY_COLS) <= set(m.entries.columns)
