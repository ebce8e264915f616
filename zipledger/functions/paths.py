"""Path and file-name rules as Spark column expressions (JVM-side, codegen).

Each function returns a ``Column`` so that the rule runs inside whole-stage
codegen and can be combined with Parquet pushdown; none of them is a UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference for equal results) -------------
# Target extensions of the default ("video") mode, compared after lower-casing.
VIDEO_EXTENSIONS = (
    ".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm", ".m4v",
    ".3gp", ".3g2", ".asf", ".divx", ".f4v", ".m2ts", ".mts", ".ogv",
    ".rm", ".rmvb", ".vob", ".xvid", ".mpg", ".mpeg", ".m1v", ".m2v",
)
# Directory names pruned (exact, case-sensitive) during a recursive walk.
EXCLUDED_DIRECTORIES = (
    "System Volume Information", "$RECYCLE.BIN", "Windows", "Program Files",
    "Program Files (x86)", ".git", "__pycache__",
)
# Lower-cased name of the export folder searched in takeout mode.
TAKEOUT_FOLDER = "googletakeout"
# ------------------------------------------------------------------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(c) -> Column:
    """Text after the last '/' (``os.path.basename`` on POSIX)."""
    return F.substring_index(_c(c), "/", -1)


def extension(c) -> Column:
    """``os.path.splitext(lower(c))[1]``: last dot of the last component,
    leading dots of the component do not start an extension."""
    return F.regexp_extract(F.lower(basename(c)), r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def is_target(c, all_files: bool = False, extensions: Iterable[str] | None = None) -> Column:
    """Target-file predicate: every file when ``all_files``, else by extension (video by default)."""
    if all_files:
        return F.lit(True)
    return extension(c).isin([e.lower() for e in (VIDEO_EXTENSIONS if extensions is None else extensions)])


def is_directory_entry(c) -> Column:
    """A ZIP directory entry is named with a trailing '/'."""
    return _c(c).endswith("/")


def ascii_fold(c) -> Column:
    """ASCII-only lower-casing, as SQLite's LIKE does (non-ASCII kept as is)."""
    return F.translate(_c(c), _UPPER, _LOWER)


def _fold_text(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def like_contains_pattern(pattern: str, case_sensitive: bool = False) -> str:
    """``%pattern%`` with '%' and '_' kept as wildcards and '\\' literal."""
    p = pattern if case_sensitive else _fold_text(pattern)
    return "%" + p.replace("\\", "\\\\") + "%"


def like_contains(c, pattern: str, case_sensitive: bool = False) -> Column:
    """``name LIKE '%pattern%'`` with SQLite's default case rule."""
    target = _c(c) if case_sensitive else ascii_fold(c)
    return target.like(like_contains_pattern(pattern, case_sensitive))


def like_suffix(c, suffix: str) -> Column:
    """``name LIKE '%<suffix>'`` with SQLite's default case rule."""
    return ascii_fold(c).like("%" + _fold_text(suffix).replace("\\", "\\\\"))


def regex_find(c, pattern: str, ignore_case: bool = False) -> Column:
    """Unanchored regular-expression find."""
    return _c(c).rlike(("(?i)" if ignore_case else "") + pattern)


def drive_label(c, path_style: str = "posix") -> Column:
    """Drive label of an archive path.

    ``windows``: text before the first ':' plus ':'.  ``wsl``: ``/mnt/<x>/...``
    with a single letter ``x`` gives ``X:``, otherwise as ``posix``.
    ``posix``: first path component other than the root; ``/`` when none.
    """
    p = _c(c)
    if path_style == "windows":
        return F.concat(F.substring_index(p, ":", 1), F.lit(":"))
    lead = F.length(F.regexp_extract(p, r"^(/*)", 1))
    comps = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    root_tok = F.when(lead == 2, F.lit("//")).when(lead > 0, F.lit("/"))
    parts = F.when(root_tok.isNotNull(), F.concat(F.array(root_tok), comps)).otherwise(comps)
    first = (F.when(root_tok == "//", F.lit("//"))
             .when(F.size(comps) > 0, F.try_element_at(comps, F.lit(1)))
             .otherwise(F.lit("/")))
    if path_style != "wsl":
        return first
    p1 = F.try_element_at(parts, F.lit(2))
    p2 = F.try_element_at(parts, F.lit(3))
    wsl = (F.size(parts) >= 3) & (p1 == "mnt") & p2.rlike(r"^\p{L}\z")
    return F.when(wsl, F.concat(F.upper(p2), F.lit(":"))).otherwise(first)


def normpath(c) -> Column:
    """``posixpath.normpath`` as a fold over the path components."""
    p = _c(c)
    lead = F.length(F.regexp_extract(p, r"^(/*)", 1))
    initial = F.when(lead == 2, F.lit("//")).when(lead > 0, F.lit("/")).otherwise(F.lit(""))

    # the accumulator is the normalised relative part, components joined by '/'
    def step(acc, x):
        last = F.substring_index(acc, "/", -1)
        popped = F.regexp_replace(acc, r"/?[^/]*\z", "")
        appended = F.when(acc == "", x).otherwise(F.concat(acc, F.lit("/"), x))
        return (F.when((x == "") | (x == "."), acc)
                .when(x == "..",
                      F.when((acc != "") & (last != ".."), popped)
                      .when(initial != "", acc)
                      .otherwise(appended))
                .otherwise(appended))

    folded = F.aggregate(F.split(p, "/"), F.lit(""), step)
    s = F.concat(initial, folded)
    return F.when(s == "", F.lit(".")).otherwise(s)


def resolve_output_path(c, wsl: bool = False) -> Column:
    """Output-folder normalisation: ``c:\\x\\y`` becomes ``/mnt/c/x/y`` on WSL,
    every other path goes through ``normpath``."""
    p = _c(c)
    if not wsl:
        return normpath(p)
    win = F.substring(p, 1, 3).isin("c:\\", "C:\\")
    rest = F.translate(F.substring(p, 4, 1 << 30), "\\", "/")
    return F.when(win, F.concat(F.lit("/mnt/c/"), rest)).otherwise(normpath(p))
