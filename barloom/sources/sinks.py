"""Sinks with the reference semantics: upsert, insert-ignore and latest-per-key tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.ticks import bar_fault


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row per key by `order`."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing with incoming's rows inserted, or put in place of rows with the same keys."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(both, keys, ["_new"]).drop("_new")


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of incoming to append: one per key, none whose key is there already."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


#: Parts of a day's bars, by symbol.
BUCKETS = 16


def _placed(bars: DataFrame, buckets: int) -> DataFrame:
    return bars.withColumns({"date": F.to_date("ts"), "bucket": F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")})


def _write(placed: DataFrame, path: str) -> None:
    ordered = placed.repartition("date", "bucket").sortWithinPartitions("date", "bucket", "symbol", "ts")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "bucket").parquet(path)


def write_bars(bars: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes bars by date and symbol bucket, in place of all bars in the parts they touch; `merge_bars` keeps those."""
    _write(_placed(bars, buckets), path)


def merge_bars(bars: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Upserts bars into a table of `write_bars`: only the (date, bucket) parts that bars touch are read and written anew, a
    bar with the symbol and time of one that is there takes its place. The same bars again change nothing, so a replayed
    micro-batch is harmless. Of two incoming bars of one symbol and time the one with more trades stays, then the one of
    higher volume. Bars that `bar_fault` finds invalid are left out. The parts of one write are a task each, never a whole day."""
    spark = bars.sparkSession
    new = latest(bars.filter(bar_fault().isNull()), ["symbol", "ts"], ["trade_count", "volume"])
    placed = _placed(new, buckets)
    try:
        held = spark.read.schema(bars.schema.add("date", "date").add("bucket", "integer")).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return _write(placed, path)
    # Partition pruning at run time: the touched parts are found first, then only their files are read.
    touched = placed.select("date", "bucket").distinct()
    return _write(upsert(held.join(F.broadcast(touched), ["date", "bucket"], "left_semi").select(*placed.columns), placed, ["symbol", "ts"]), path)


def latest_values(df: DataFrame, now, ttl_seconds: int = 600) -> DataFrame:
    """The latest row per symbol, unless older than the time to live at `now`."""
    return latest(df, ["symbol"], ["ts"]).filter(F.unix_seconds("ts") > F.unix_seconds(F.lit(now).cast("timestamp")) - ttl_seconds)
