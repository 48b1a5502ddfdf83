"""Structured Streaming: ticks to bars (watermark), bars to recursive indicators (keyed state, begun from history), alerts
with cooldown, sinks. `streaming.metrics` has the catalogue's metrics, `streaming.scan` rules and lists."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators import indicators as I
from barloom.operators.bars import _ohlcv
from barloom.operators.cooldown import ties
from barloom.sources.ticks import TICK, tick_fault


def stream_bars(ticks: DataFrame, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """Bars of a tick stream: late ticks within the bound update their own bar, later ones are dropped.

    Sinks in append mode get a bar once, when the watermark closes it; in update mode, whenever it changes. A row of
    `drain_marker` among the ticks moves the watermark on, so that all bars before its time are closed."""
    timed = ticks.withWatermark("ts", late)
    # A marker has no symbol: it is seen by the watermark and dropped here as invalid.
    valid = timed.filter(tick_fault().isNull())
    return valid.groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w")).agg(*_ohlcv()).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap", "trade_count")


def drain_marker(spark: SparkSession, at, late_seconds: int = 300, seconds: int = 60) -> DataFrame:
    """The one row to append to a tick source so that `stream_bars` closes every bar with ticks up to the instant `at`. Ticks
    that come after it for those bars are late: send it when a day or a replay is over."""
    when = (F.lit(at).cast("timestamp") + F.make_interval(secs=F.lit(late_seconds + seconds + 1))).alias("ts")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in TICK if f.name not in ("ts", "type")]
    return spark.range(1).select(*none, when, F.lit("drain").alias("type")).select(*TICK.names)


class RecursiveIndicators(StatefulProcessor):
    """Per symbol: the fold's few numbers and the time of its last bar, kept between batches."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "us bigint, fold string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        self.held.update((int(initialState["us"].iloc[0]), initialState["fold"].iloc[0]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        us, fold = self.held.get() if self.held.exists() else (None, None)
        new = pd.concat(list(rows))
        if len(new):  # a symbol of the history alone comes with an empty frame
            new = new.sort_values("bar_us", kind="stable")
            new = new if us is None else new[new["bar_us"] > us]
        if len(new):
            fold = I._Fold(self.names) if fold is None else I._Fold.restored(self.names, fold)
            made = fold.feed(new["close"].to_numpy(dtype=float))
            self.held.update((int(new["bar_us"].iloc[-1]), fold.state()))
            yield new.drop(columns="bar_us").assign(**made)

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, names: list[str], history: DataFrame | None = None) -> DataFrame:
    """A bar stream with the named EMA, MMA, RSI and MACD columns.

    history: bars from which each symbol's state is rebuilt before the first batch (a new query's start, or one whose
    checkpoint is lost); a restarted query goes on from its own checkpoint. Bars not later than the last one folded, such
    as those a replay repeats, are skipped.
    """
    names = I._known_recursive(names)
    schema = T.StructType([*bars.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    first = None if history is None else I.fold_states(history, names).groupBy("symbol")
    return bars.withColumn("bar_us", F.unix_micros("ts")).groupBy("symbol").transformWithStateInPandas(RecursiveIndicators(names), schema, "Append", "None", first)


class Cooldown(StatefulProcessor):
    """Per rule and symbol: lets a match through when the cooldown since the last one let through has gone by."""

    def __init__(self, seconds: int, ttl_seconds: int | None = None):
        self.seconds, self.ttl_seconds = seconds, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp", self.ttl_seconds and 1000 * self.ttl_seconds)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        self.last.update((initialState["ts"].iloc[0].to_pydatetime(),))

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        new = pd.concat(list(rows))
        if not len(new):  # a key of the history alone comes with an empty frame
            return
        new = new[new["ts"].notna()].sort_values(["ts", *ties(list(new.columns))], kind="stable").reset_index(drop=True)
        for i, ts in zip(new.index, new["ts"], strict=True):
            if last is None or (ts.to_pydatetime() - last).total_seconds() >= self.seconds:
                last = ts.to_pydatetime()
                kept.append(i)
        if kept:
            self.last.update((last,))
        yield new.loc[kept]

    def close(self) -> None:
        pass


def last_fired(alerts: DataFrame) -> DataFrame:
    """(rule_id, symbol, ts): when each rule last fired for a symbol, from which a cooldown goes on."""
    return alerts.filter("ts is not null").groupBy("rule_id", "symbol").agg(F.max("ts").alias("ts"))


def stream_cooldown(matches: DataFrame, seconds: int, ttl_seconds: int | None = None, history: DataFrame | None = None) -> DataFrame:
    """Matches let through. history: alerts that fired before, with which a new query, or one whose checkpoint is lost, goes
    on. With ttl_seconds, a rule and symbol not heard of for so long (by the clock) are forgotten, so
    state stays bounded; give more than the cooldown plus the stream's delay. Such a stream always has timers to serve, so
    it never drains: start its sink with drain=False."""
    if ttl_seconds is not None and ttl_seconds < seconds:
        raise ValueError("state must live as long as the cooldown")
    mode = "None" if ttl_seconds is None else "ProcessingTime"
    first = None if history is None else last_fired(history).groupBy("rule_id", "symbol")
    return matches.groupBy("rule_id", "symbol").transformWithStateInPandas(Cooldown(seconds, ttl_seconds), matches.schema, "Append", mode, first)


def stream_dedup(alerts: DataFrame, ttl: str = "1 hour") -> DataFrame:
    return alerts.withWatermark("ts", ttl).withColumn("second", F.date_trunc("second", "ts")).dropDuplicatesWithinWatermark(["rule_id", "symbol", "second"]).drop("second")


def append(df: DataFrame, path: str, checkpoint: str, drain: bool = True):  # noqa: ANN201
    """A parquet stream sink; drain processes what is there and stops."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, drain: bool = True, mode: str = "append"):  # noqa: ANN201
    """A foreachBatch sink (upserts, insert-ignore, scans, toplist pages); `write` must be idempotent."""
    writer = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def late_rows(query) -> int:  # noqa: ANN001
    """Rows that a query's recent batches dropped as later than the watermark, as its stateful operators count them (ticks
    of one symbol and window that arrive in one task count once)."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
