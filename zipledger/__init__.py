"""zipledger — a Spark-native catalogue of ZIP archive contents.

Archives are listed under a set of roots, each archive's central directory is
exploded into entry rows on the executors, the rows are kept as an append-only
Parquet catalogue, and catalogue questions (search, listing, statistics,
merge, duplicates, validation, extraction) are answered with DataFrame plans.
"""

from zipledger.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
__version__ = "0.1.0"
