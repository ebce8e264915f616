"""Extracted files on file systems without links: whole files or none, also after a retry."""

import hashlib
import io
import os

import pytest
from pyarrow.fs import LocalFileSystem, SubTreeFileSystem

from zipledger.operators.extract import _copy, _copy_remote

DATA = bytes(range(256)) * 9000   # several chunks


class Breaks(io.BytesIO):
    """A source whose reader is lost after the first chunk."""

    def read(self, n=-1):
        if self.tell() >= 1 << 20:
            raise OSError("lost")
        return super().read(n)


def test_attempts(scratch):
    fs, target = SubTreeFileSystem(scratch, LocalFileSystem()), "out/sub/a.mp4"
    with pytest.raises(OSError, match="lost"):
        _copy_remote(Breaks(DATA), fs, target)
    assert os.listdir(f"{scratch}/out/sub") == []            # no partial file under any name
    want = (len(DATA), hashlib.sha256(DATA).hexdigest())
    assert _copy_remote(io.BytesIO(DATA), fs, target) == want
    assert _copy_remote(io.BytesIO(DATA), fs, target) == want   # retried after it had finished
    for foreign in (b"other", DATA[:-1] + b"?"):             # another size, another byte
        with open(f"{scratch}/out/sub/a.mp4", "wb") as fh:
            fh.write(foreign)
        with pytest.raises(FileExistsError):
            _copy_remote(io.BytesIO(DATA), fs, target)
        with open(f"{scratch}/out/sub/a.mp4", "rb") as fh:
            assert fh.read() == foreign
    assert os.listdir(f"{scratch}/out/sub") == ["a.mp4"]


def test_empty_file_and_local_path(scratch):
    fs = SubTreeFileSystem(scratch, LocalFileSystem())
    assert _copy_remote(io.BytesIO(b""), fs, "e.bin") == (0, hashlib.sha256(b"").hexdigest())
    assert _copy(io.BytesIO(DATA), f"{scratch}/l/a.bin")[0] == len(DATA)
    with pytest.raises(OSError, match="lost"):
        _copy(Breaks(DATA), f"{scratch}/l/b.bin")
    assert os.listdir(f"{scratch}/l") == ["a.bin"]
