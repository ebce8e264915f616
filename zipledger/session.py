"""Session construction and the shared working folder.

Everything that has to outlive a task (checkpoints, packed fixture archives,
extraction outputs of tests) goes below ``spark.checkpoint.dir``: on a cluster
that setting names a folder every executor can reach. A private folder is only
created when the setting is absent, which is the case in local tests.
"""

from __future__ import annotations

import os
import re
import tempfile
import threading

from pyspark.sql import SparkSession

# Settings that hold for every job of the library. Shuffle partitions are left
# to the caller (cluster default or test value); AQE coalesces them at runtime.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "zipledger",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def _strip_file_scheme(path: str) -> str:
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a private temp folder only when unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="zipledger-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A sub-folder of the shared checkpoint folder (created for local paths)."""
    base = checkpoint_root(spark)
    path = "/".join([base.rstrip("/")] + [p.strip("/") for p in parts if p])
    local = _strip_file_scheme(path)
    if "://" not in local:
        os.makedirs(local, exist_ok=True)
        return local
    return path


def materialize(df, name: str):
    """Write ``df`` once to a Parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes ``df`` exactly once (a
    reliable checkpoint of an unpersisted plan computes it twice), which
    matters for side-effecting steps and for expensive reads of archives.
    """
    import uuid as _uuid
    spark = df.sparkSession
    path = f"{_stage_root(spark)}/{name}-{_uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stage_root(spark: SparkSession) -> str:
    return shared_dir(spark, "zipledger-stage", spark.sparkContext.applicationId)


def clear_stage(spark: SparkSession, *names: str) -> None:
    """Remove this application's staged tables (those of the given names, or all).

    For use when the DataFrames that read them are no longer needed; the streaming
    cataloguer does it after every micro-batch."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    filesystem = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in filesystem.listStatus(root):
        if not names or status.getPath().getName().rsplit("-", 1)[0] in names:
            filesystem.delete(status.getPath(), True)


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``zipledger`` importable in executor Python workers (once per app).

    The executor-side steps (reader, walker, extractor, hasher) are functions
    of this package; Spark ships the zipped package with ``addPyFile``, the
    standard way to distribute Python code to a cluster. The zip is built on
    the driver and uploaded by Spark; concurrent callers ship it once.
    """
    sc = spark.sparkContext
    with _SHIP_LOCK:
        if sc.applicationId in _SHIPPED:
            return
        _ship(sc)
        _SHIPPED.add(sc.applicationId)


def _ship(sc) -> None:
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="zipledger-code-"), "zipledger.zip")
    with zipfile.ZipFile(out, "w", compression=zipfile.ZIP_DEFLATED) as zf:
        for root, dirs, files in os.walk(pkg_dir):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, parent))
    sc.addPyFile(out)
