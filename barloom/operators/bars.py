"""Ticks to OHLCV bars, coarser bars, daily references and bar queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import sessions as S
from barloom.sources.ticks import split_valid


def start_of(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def _ohlcv() -> list[Column]:
    at = F.struct("ts", "seq")
    volume = F.sum("size")
    return [
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), volume.alias("volume"),
        F.when(volume == 0, 0.0).otherwise(F.sum(F.col("price") * F.col("size")) / volume).alias("vwap"), F.count(F.lit(1)).alias("trade_count"),
    ]


def ticks_to_bars(ticks: DataFrame, seconds: int = 60) -> DataFrame:
    """Final bars, one row per symbol and interval: partial aggregation on the map side, one exchange."""
    valid, _ = split_valid(ticks)
    return valid.groupBy("symbol", start_of(F.col("ts"), seconds).alias("bar")).agg(*_ohlcv()).withColumnRenamed("bar", "ts")


#: Ticks of one part, and the parts up to which a shuffle writes rows straight to files, without sorting them in memory.
PART_ROWS, PARTS = 100_000, 200


def dealt(ticks: DataFrame) -> DataFrame:
    """Ticks dealt by symbol into parts whose number grows with theirs: for many symbols with few ticks a bar, where
    combining before the shuffle gains nothing. Bars, daily references and what is joined or ordered by symbol then stay in
    their parts, so no task holds more than a part's rows."""
    return ticks.repartition(min(max(math.ceil(ticks.count() / PART_ROWS), 1), PARTS), "symbol")


def live_bars(ticks: DataFrame, at, seconds: int = 60) -> DataFrame:
    """The unfinished bar of each symbol as of an instant."""
    now = F.lit(at).cast("timestamp")
    return ticks_to_bars(ticks.filter((F.col("ts") <= now) & (F.col("ts") >= start_of(now, seconds))), seconds)


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Coarser bars from bars; vwap weighted by volume."""
    return regroup(bars, start_of(F.col("ts"), seconds))


def regroup(bars: DataFrame, start: Column) -> DataFrame:
    """Coarser bars, one for each symbol and interval start."""
    volume = F.sum("volume")
    return (
        bars.groupBy("symbol", start.alias("bar"))
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), volume.alias("volume"),
            F.when(volume == 0, 0.0).otherwise(F.sum(F.col("vwap") * F.col("volume")) / volume).alias("vwap"), F.sum("trade_count").alias("trade_count"),
        )
        .withColumnRenamed("bar", "ts")
    )


def daily(bars: DataFrame) -> DataFrame:
    """Daily OHLCV per ET date with today_open, today_close and yesterday_close."""
    session = S.market_session(F.col("ts"))
    in_market, after = session == "market", session == "postmarket"
    volume = F.sum("volume")
    days = bars.groupBy("symbol", S.et_date(F.col("ts")).alias("et_date")).agg(
        F.min_by("open", "ts").alias("today_open"), F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.max_by("close", "ts").alias("day_close"), volume.alias("day_volume"),
        F.coalesce(F.max_by(F.when(in_market, F.col("close")), F.when(in_market, F.col("ts"))), F.min_by(F.when(after, F.col("close")), F.when(after, F.col("ts")))).alias("today_close"),
    )
    before = Window.partitionBy("symbol").orderBy("et_date").rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("yesterday_close", F.last("today_close", ignorenulls=True).over(before))


def bars_in_range(bars: DataFrame, symbol: str, start, end) -> DataFrame:
    return bars.filter((F.col("symbol") == symbol) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).orderBy("ts")


def latest_bars(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return bars.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def search_symbols(df: DataFrame, part: str) -> DataFrame:
    return df.select("symbol").distinct().filter(F.contains(F.lower("symbol"), F.lit(part.lower())))
