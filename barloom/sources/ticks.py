"""Tick tables: reading, validation and the views over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICK = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("price", T.DoubleType()),
    T.StructField("size", T.LongType()), T.StructField("type", T.StringType()), T.StructField("bid", T.DoubleType()), T.StructField("ask", T.DoubleType()),
])


def read_ticks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TICK).format(fmt).load(path)


def stream_ticks(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TICK).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def tick_fault() -> Column:
    """Why a tick is invalid, or null."""
    return F.when(F.coalesce(F.col("symbol"), F.lit("")) == "", "no symbol").when(~F.coalesce(F.col("price") > 0, F.lit(False)), "price not positive").when(F.col("ts").isNull(), "no timestamp")


def split_valid(ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid ticks, quarantined ticks with a reason)."""
    told = ticks.withColumn("reason", tick_fault())
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")


def bar_fault() -> Column:
    return F.when(F.coalesce(F.col("symbol"), F.lit("")) == "", "no symbol").when(F.col("ts").isNull(), "no timestamp").when(~F.coalesce(F.col("high") >= F.col("low"), F.lit(False)), "high below low").when(~F.coalesce(F.col("volume") >= 0, F.lit(False)), "negative volume")


def ticks_from_events(spark: SparkSession, sf_dir: str, symbol: str = "user_id") -> DataFrame:
    """Ticks of the events table; symbol is user_id or event_type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    none = F.lit(None).cast("double")
    return events.select(
        F.col(symbol).cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("size"), F.lit("trade").alias("type"), none.alias("bid"), none.alias("ask"),
    )


def ticks_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    none = F.lit(None).cast("double")
    return items.select(
        F.col("l_partkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("long").alias("size"), F.lit("trade").alias("type"), none.alias("bid"), none.alias("ask"),
    )
