"""Report-side column expressions: size units, shortening, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024
GIB = 1024 * 1024 * 1024


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def size_mb(c) -> Column:
    """bytes / 1024**2, with a NULL or zero size shown as 0."""
    return F.coalesce(_c(c), F.lit(0)) / F.lit(float(MIB))


def size_gb(c) -> Column:
    """bytes / 1024**3 (totals)."""
    return F.coalesce(_c(c), F.lit(0)) / F.lit(float(GIB))


def shorten(c, limit: int, keep: int) -> Column:
    """Longer than ``limit`` characters: first ``keep`` characters plus '...'."""
    col = _c(c)
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, keep), F.lit("..."))).otherwise(col)


def clip(c, n: int) -> Column:
    """First ``n`` characters (Python slicing ``s[:n]``)."""
    return F.substring(_c(c), 1, n)


def thousands(c) -> Column:
    """Integer with ',' thousands separators."""
    return F.format_number(_c(c), 0)
