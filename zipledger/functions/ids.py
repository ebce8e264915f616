"""Deterministic archive identifiers.

The catalogue keys an archive by a uuid-shaped md5 of its path, so a rerun of
the same scan produces the same keys (no random uuid4).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def archive_uuid(path) -> Column:
    h = F.md5(F.col(path) if isinstance(path, str) else path)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def archive_uuid_py(path: str) -> str:
    h = hashlib.md5(path.encode("utf-8")).hexdigest()
    return f"{h[0:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"
