"""Extracted files under way: in a folder of their task, not among the finished ones."""

import io
import os

import pytest

from zipledger.operators import extract as X


class Breaks(io.BytesIO):
    def read(self, n=-1):
        if self.tell():
            raise OSError("lost")
        return super().read(min(n, 10))


def test_the_shared_folder_gets_one_name_per_file(scratch, monkeypatch):
    seen, link = [], os.link

    def linked(tmp, target):
        seen.append((os.path.dirname(tmp), os.path.dirname(target), sorted(n for n in os.listdir(os.path.dirname(target)) if n[0] != ".")))
        link(tmp, target)
    monkeypatch.setattr(os, "link", linked)
    unfinished = X.Unfinished()
    for i, folder in enumerate(["o", "o", "o/sub", "o"]):
        assert X._copy(io.BytesIO(b"x" * i), f"{scratch}/{folder}/{i}.mp4", unfinished)[0] == i
    assert all(tmp != target for tmp, target, _ in seen) and len({tmp for tmp, _, _ in seen}) == 2   # one each
    assert [names for _, _, names in seen] == [[], ["0.mp4"], [], ["0.mp4", "1.mp4", "sub"]]
    unfinished.close()
    assert sorted(os.listdir(f"{scratch}/o")) == ["0.mp4", "1.mp4", "3.mp4", "sub"]
    assert os.listdir(f"{scratch}/o/sub") == ["2.mp4"]


def test_after_a_failure_the_next_file_is_whole(scratch):
    unfinished = X.Unfinished()
    os.makedirs(f"{scratch}/o")
    with open(f"{scratch}/o/taken.mp4", "wb") as fh:
        fh.write(b"foreign")
    for src, name, error in ((Breaks(b"y" * 99), "lost.mp4", OSError), (io.BytesIO(b"mine"), "taken.mp4", FileExistsError)):
        with pytest.raises(error):
            X._copy(src, f"{scratch}/o/{name}", unfinished)
    for _ in range(2):   # the second time as a retry that finds its own bytes
        assert X._copy(io.BytesIO(b"next"), f"{scratch}/o/next.mp4", unfinished)[0] == 4
    unfinished.close()
    assert sorted(os.listdir(f"{scratch}/o")) == ["next.mp4", "taken.mp4"]
    assert open(f"{scratch}/o/taken.mp4", "rb").read() == b"foreign" and open(f"{scratch}/o/next.mp4", "rb").read() == b"next"


def test_a_task_leaves_no_folder(scratch):
    import zipfile

    import pandas as pd
    with zipfile.ZipFile(f"{scratch}/a.zip", "w") as zf:
        for name in ("a.mp4", "b.mp4"):
            zf.writestr(name, name)
    rows = pd.DataFrame({"plan_pos": [1, 2, 3], "archive_path": f"{scratch}/a.zip", "path_in_archive": ["a.mp4", "b.mp4", "c.mp4"],
                         "entry_ordinal": [0, 1, 2], "output_path": [f"{scratch}/o/{n}.mp4" for n in "abc"]})
    out = pd.concat(X._extract_entries(iter([rows])))
    assert list(out["status"]) == ["ok", "ok", "missing"]
    assert sorted(os.listdir(f"{scratch}/o")) == ["a.mp4", "b.mp4"]
