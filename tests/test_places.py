"""Entries read from the places the catalogue knows, without the archive's directory."""

import io
import os
import zipfile

from zipledger.operators.quality import hash_entries
from zipledger.sources.reader import _RAW_COLS, _read_directories, read_central_directories
from zipledger.sources.slices import Opened, sliced


def _rows(path):
    """Reader rows of one archive as dicts."""
    import pandas as pd
    batches = _read_directories(1000)([pd.DataFrame({"archive_path": [path], "drive": ["D:"]})])
    return [dict(zip(_RAW_COLS, r)) for b in batches for r in b.itertuples(index=False, name=None)]


CONTENTS = {"plain.txt": b"abc" * 1000, "d/empty": b"", "ä/Ω.bin": bytes(range(256)) * 40, "caf\u00e9.txt": b"x"}


def _archive(path, method, prefix=b"", zip64=False, streamed=False):
    with open(path, "wb") as fh:
        fh.write(prefix)
        target = fh
        if streamed:   # sizes and checksum follow the bytes
            class Pipe(io.RawIOBase):
                writable = lambda self: True
                write = lambda self, b: fh.write(b)
            target = Pipe()
        with zipfile.ZipFile(target, "w", method) as zf:
            for name, data in CONTENTS.items():
                with zf.open(name, "w", force_zip64=zip64) as out:
                    out.write(data)
    return path


def test_bytes_equal_without_the_directory(scratch):
    methods = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)
    for i, kw in enumerate([dict(method=m) for m in methods] + [
            dict(method=8, prefix=b"#!/bin/sh\n" * 9), dict(method=0, zip64=True), dict(method=8, streamed=True)]):
        opened = Opened()
        for row in _rows(_archive(f"{scratch}/{i}.zip", **kw)):
            with opened.read(row) as src:
                assert src.read() == CONTENTS[row["path_in_archive"]]
            assert opened.zip is None, kw   # the directory was not parsed
        opened.close()


def test_entry_of_an_inner_archive(scratch):
    inner = _archive(f"{scratch}/inner.zip", 8)
    with zipfile.ZipFile(f"{scratch}/outer.zip", "w") as zf:
        zf.write(inner, "in/inner.zip")
    opened = Opened()
    for row in _rows(f"{scratch}/outer.zip!/in/inner.zip"):
        assert opened.read(row).read() == CONTENTS[row["path_in_archive"]] and opened.zip is None


def test_changed_archive_is_read_by_its_directory(scratch):
    path = f"{scratch}/a.zip"
    rows = _rows(_archive(path, 0))
    with zipfile.ZipFile(path, "w") as zf:   # the same names, other bytes, other places
        for name, data in reversed(CONTENTS.items()):
            zf.writestr(name, data + b"!")
    opened = Opened()
    names = list(reversed(CONTENTS))
    for row in rows:
        with opened.read(row) as src:   # what the archive holds at the entry's number
            assert src.read() == CONTENTS[names[row["entry_ordinal"]]] + b"!"
    # rows without a place, as catalogues written before have them
    assert opened.read({**rows[0], "header_offset": None}).read() == CONTENTS[names[0]] + b"!"


def test_corrupt_byte_is_found(scratch):
    path = _archive(f"{scratch}/a.zip", 0)
    row = next(r for r in _rows(path) if r["path_in_archive"] == "plain.txt")
    with open(path, "r+b") as fh:
        fh.seek(row["header_offset"] + 30 + len("plain.txt") + 100)
        fh.write(b"?")
    try:
        Opened().read(row).read()
        raise AssertionError("a wrong byte passed")
    except zipfile.BadZipFile as e:
        assert "CRC" in str(e)


def test_hashes_do_not_need_the_directory(spark, scratch):
    import hashlib
    path = _archive(f"{scratch}/a.zip", 8)
    listing = spark.createDataFrame([(path, "D:")], "archive_path string, drive string")
    rows = spark.createDataFrame(read_central_directories(listing).collect(),
                                 read_central_directories(listing).schema)
    with open(path, "r+b") as fh:   # the directory's end is gone
        fh.truncate(os.path.getsize(path) - 10)
    got = {r.path_in_archive: r.content_hash for r in hash_entries(rows).collect()}
    assert got == {n: hashlib.sha256(d).hexdigest() for n, d in CONTENTS.items()}


def test_slices_keep_every_row_once(spark):
    # one archive with nearly all entries, some of several slices' size, rows without a number
    rows = [("big", i, (300 << 20) if i % 7 == 0 else 1000) for i in range(70_000)]
    rows += [("small", 0, 5), ("bad", None, None)]
    df = spark.createDataFrame(rows, "archive_path string, entry_ordinal int, compressed_size long")
    got = sliced(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
