"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zipledger.session import shared_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns the operators work on; other columns, whatever their names, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def aside(docs: DataFrame) -> DataFrame:
    """``docs`` with neutral names for all columns but doc_id and text, so that none clashes with an operator's own.

    ``.toDF(*docs.columns)`` gives the names back."""
    return docs.toDF(*[c.lower() if c.lower() in ("doc_id", "text") else f"other_{i}" for i, c in enumerate(docs.columns)])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage as ``checkpoint()`` does, but computes ``df`` once and keeps
    only a compressed columnar copy; a lost executor rereads the files.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "llm-stage") + f"/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str, order: list[str]) -> DataFrame:
    """``stage`` with the rows dealt by the hash of ``key``, in ``order``, so that grouping by it moves none of them.

    Files carry that only as a table of the session's catalog; it is taken off the catalog again, the files stay."""
    spark = df.sparkSession
    path = shared_dir(spark, "llm-stage") + f"/{name}-{uuid.uuid4().hex}"
    table = f"spark_catalog.default.zipledger_{name}_{uuid.uuid4().hex}"
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(pieces, key).sortBy(*order).option("path", path).option("compression", "zstd").saveAsTable(
        table, format="parquet")
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # external: without its files
    return rows


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column: one number, from which task counts follow."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many tasks of about ``each`` bytes (or rows) ``total`` makes."""
    return max(least, -(-int(total) // int(each)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def ship(spark: SparkSession) -> None:
    """Executors import the functions of this package."""
    ship_package(spark)
