"""Path and name rules against the Python standard library (F-11, F-12)."""

import os
import posixpath
import sqlite3
from pathlib import PurePosixPath

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zipledger.functions import paths as P
from zipledger.functions.paths import VIDEO_EXTENSIONS

F11 = ["a.mp4", ".mp4", "..mp4", ".a.mp4", "a..mp4", "d.mp4/file", "x/y.MOV", "foo.", "a.tar.gz",
       "dir/.mp4", "d/..a.b", "nodot", "a/", "", "a.mp4\n", "ä.MKV", "x/.hidden/y.webm"]
F12_NAMES = ["ABC", "Ä", "a\\b", "a1b", "a%b", "IMG_2.mp4", "abc", "ä", "xABCx"]
F12_PATTERNS = ["%b%", "ä", "a_b", "a\\b", "", "B", "img_", "%"]


def _eval(spark, values, exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", *[e(F.col("v")).alias(f"c{k}") for k, e in enumerate(exprs)]).collect()
    return {r.i: tuple(r[f"c{k}"] for k in range(len(exprs))) for r in rows}


def _ref_ext(name):
    return os.path.splitext(name.lower())[1]


def test_extension_rule(spark):
    got = _eval(spark, F11, [P.extension, P.is_target, P.basename])
    for i, name in enumerate(F11):
        ext, target, base = got[i]
        assert ext == _ref_ext(name), name
        assert target == (_ref_ext(name) in VIDEO_EXTENSIONS), name
        assert base == os.path.basename(name), name


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab./_M4P\n", max_size=10), min_size=1, max_size=60))
def test_extension_random(spark, names):
    got = _eval(spark, names, [P.extension])
    for i, name in enumerate(names):
        assert got[i][0] == _ref_ext(name), repr(name)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab./", max_size=12), min_size=1, max_size=60))
def test_normpath_random(spark, paths):
    got = _eval(spark, paths, [P.normpath])
    for i, p in enumerate(paths):
        assert got[i][0] == posixpath.normpath(p), repr(p)


def test_resolve_output_path_wsl(spark):
    vals = ["c:\\Users\\me\\out", "C:\\x", "d:\\x", "/tmp/./a/../b", "rel//x/"]
    got = _eval(spark, vals, [lambda c: P.resolve_output_path(c, wsl=True)])
    assert got[0][0] == "/mnt/c/Users/me/out"
    assert got[1][0] == "/mnt/c/x"
    assert got[2][0] == posixpath.normpath("d:\\x")
    assert got[3][0] == "/tmp/b"
    assert got[4][0] == "rel/x"


def _ref_label(path, wsl):
    parts = PurePosixPath(path).parts
    if wsl and len(parts) >= 3 and parts[1] == "mnt":
        letter = parts[2]
        if len(letter) == 1 and letter.isalpha():
            return f"{letter.upper()}:"
    for part in parts:
        if part != "/":
            return part
    return "/"


def test_drive_label(spark):
    vals = ["/mnt/c/GoogleTakeout/a.zip", "/mnt/cd/x.zip", "/media/usb/a.zip", "/", "", "rel/a.zip",
            "//srv/share/a.zip", "/./mnt/d/x", "x/mnt/e/y", "/mnt/1/x", "./a/b", "/mnt/ä/x"]
    got = _eval(spark, vals, [lambda c: P.drive_label(c, "posix"), lambda c: P.drive_label(c, "wsl"),
                              lambda c: P.drive_label(c, "windows")])
    for i, v in enumerate(vals):
        assert got[i][0] == _ref_label(v, False), v
        assert got[i][1] == _ref_label(v, True), v
        assert got[i][2] == v.split(":")[0] + ":", v


def test_like_parity_with_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (name TEXT)")
    con.executemany("INSERT INTO t VALUES (?)", [(n,) for n in F12_NAMES])
    df = spark.createDataFrame([(n,) for n in F12_NAMES], "file_name string")
    for pat in F12_PATTERNS:
        want = sorted(r[0] for r in con.execute("SELECT name FROM t WHERE name LIKE ?", (f"%{pat}%",)))
        got = sorted(r.file_name for r in df.filter(P.like_contains("file_name", pat)).collect())
        assert got == want, pat


def test_suffix_and_regex(spark):
    df = spark.createDataFrame([(n,) for n in ["a.MP4", "b.mp4", "c.mp4x", "IMG_01.mov"]], "file_name string")
    assert sorted(r[0] for r in df.filter(P.like_suffix("file_name", ".mp4")).collect()) == ["a.MP4", "b.mp4"]
    assert [r[0] for r in df.filter(P.regex_find("file_name", "^img_", True)).collect()] == ["IMG_01.mov"]
    assert df.filter(P.regex_find("file_name", "^img_")).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aAbB_%\\\\.Ää1", max_size=6), min_size=1, max_size=40),
       st.lists(st.text(alphabet="aAbB_%\\\\.Ää", max_size=3), min_size=1, max_size=4))
def test_like_parity_random(spark, names, patterns):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (i INTEGER, name TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(names)))
    df = spark.createDataFrame(list(enumerate(names)), "i int, file_name string")
    for pat in patterns:
        want = sorted(r[0] for r in con.execute("SELECT i FROM t WHERE name LIKE ?", (f"%{pat}%",)))
        got = sorted(r.i for r in df.filter(P.like_contains("file_name", pat)).collect())
        assert got == want, (pat, names)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="/.mntcdx", max_size=12), min_size=1, max_size=60))
def test_drive_label_random(spark, paths):
    got = _eval(spark, paths, [lambda c: P.drive_label(c, "posix"), lambda c: P.drive_label(c, "wsl")])
    for i, p in enumerate(paths):
        assert got[i] == (_ref_label(p, False), _ref_label(p, True)), repr(p)
