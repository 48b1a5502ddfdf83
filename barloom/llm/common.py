"""Helpers shared by the text operators."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


#: Rows of at most a few numbers each that may be broadcast, some tens of MB.
SMALL_ROWS = 1_000_000


def materialize(df: DataFrame, name: str = "step", few: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so a lost executor never costs its lineage.

    few: df has a few numbers a row; each core writes one file, where shuffle partitions would make many small ones.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(max(8, df.sparkSession.sparkContext.defaultParallelism)) if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A materialized table of narrow rows, marked for broadcast if it has no more than `rows` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
