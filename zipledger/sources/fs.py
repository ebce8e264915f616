"""File access from executor tasks: local/NFS paths or pyarrow filesystems.

Archives are opened by path on the executor that reads them (never shipped as
bytes through Spark, so archives larger than 2 GiB are fine); ``zipfile``
only needs a seekable binary stream. An archive stored inside another has a
virtual path, ``<outer>!/<member>``, or ``<outer>!<ordinal>/<member>`` where an
earlier member of the outer archive has the same name.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from urllib.parse import unquote

#: Where a virtual path goes from an archive into a member of it.
_INTO = re.compile(r"(?<=\.zip)!(\d*)/", re.IGNORECASE)
#: A compressed inner archive up to this size is held in memory while it is read.
INNER_BYTES = 64 << 20


def local_path(path: str) -> str | None:
    """The POSIX path of a ``file:`` URI or plain path; None for remote URIs."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    if "://" in path:
        return None
    return path


def _open_file(path: str):
    lp = local_path(path)
    if lp is not None:
        return open(lp, "rb")
    from pyarrow import fs as pafs
    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def file_exists(path: str) -> bool:
    """Whether a local or remote file is there; a file system that does not answer counts as having it."""
    lp = local_path(path)
    try:
        if lp is not None:
            os.lstat(lp)
            return True
        from pyarrow import fs as pafs
        filesystem, inner = pafs.FileSystem.from_uri(path)
        return filesystem.get_file_info(inner).type != pafs.FileType.NotFound
    except FileNotFoundError:
        return False
    except Exception:
        return True


def _open_member(outer, ordinal: str, member: str):
    zf = zipfile.ZipFile(outer)
    infos = zf.infolist()
    info = (infos[int(ordinal)] if ordinal else next((i for i in infos if i.filename == member), None))
    if info is None:
        raise FileNotFoundError(f"{member} is not in the archive")
    if info.compress_type != zipfile.ZIP_STORED and info.file_size <= INNER_BYTES:
        with zf.open(info) as src:   # seeking back in a deflated member starts it over
            return io.BytesIO(src.read())
    return zf.open(info)


def open_binary(path: str):
    """A seekable stream of a file, or of a member for a virtual path."""
    steps = _INTO.split(path)
    stream = _open_file(steps[0])
    for ordinal, member in zip(steps[1::2], steps[2::2]):
        stream = _open_member(stream, ordinal, member)
    return stream


def _hadoop(spark, path: str):
    """The Hadoop path and its file system: the client Spark itself reads with."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(path: str, spark) -> bool:
    """Whether a local or remote path exists."""
    jpath, filesystem = _hadoop(spark, path)
    return bool(filesystem.exists(jpath))


def partitions_of(path: str, spark) -> set[tuple[str, str]]:
    """(scan_id, run_id) of the partitions of a stored table."""
    folder, filesystem = _hadoop(spark, path)
    found = filesystem.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "scan_id=*/run_id=*")) or []
    steps = [(p.getPath().getParent().getName(), p.getPath().getName()) for p in found]
    return {(unquote(a.split("=", 1)[1]), unquote(b.split("=", 1)[1])) for a, b in steps}


def mark(path: str, spark) -> None:
    """Make an empty file, the sign that what lies beside it is complete."""
    jpath, filesystem = _hadoop(spark, path)
    filesystem.create(jpath, True).close()


def size_of(path: str, spark) -> int:
    """The bytes of a file or folder."""
    jpath, filesystem = _hadoop(spark, path)
    return filesystem.getContentSummary(jpath).getLength()


def version_of(path: str, spark) -> str:
    """A name for the present state of a file or folder: its bytes and modification time."""
    jpath, filesystem = _hadoop(spark, path)
    return f"{size_of(path, spark)}-{filesystem.getFileStatus(jpath).getModificationTime() // 1000}"
