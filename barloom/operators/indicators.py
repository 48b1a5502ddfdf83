"""Technical indicators, one value per bar.

Fixed frames are window expressions over one (symbol, ts) order, so Spark plans one exchange and one sort for all of
them. The recursive family is a fold over each symbol's rows in order, which streams; `prefix` spreads one symbol's fold
over many tasks.
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600}
EMA_PERIODS, RSI_PERIODS, SMA_PERIODS = (9, 12, 20, 21, 26, 50, 200), (9, 14, 21), (10, 20, 50, 200)


def rows(n: int):
    return Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)


def seconds(n: int):
    return Window.partitionBy("symbol").orderBy(F.unix_seconds("ts")).rangeBetween(-n, 0)


def in_order():
    return Window.partitionBy("symbol").orderBy("ts")


def guard(n: int, value: Column) -> Column:
    """value where n bars are there, else null."""
    return F.when(F.count(F.lit(1)).over(rows(n)) >= n, value)


def vwap_range(window: str) -> Column:
    w, volume = seconds(SECONDS[window]), F.col("volume")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.when(F.sum(volume).over(w) == 0, 0.0).otherwise(F.sum(typical * volume).over(w) / F.nullif(F.sum(volume).over(w), F.lit(0)))


def volume_avg(window: str) -> Column:
    return F.avg("volume").over(seconds(SECONDS[window]))


def price_change_range_pct(window: str) -> Column:
    w = seconds(SECONDS[window])
    first = F.first("close").over(w)
    return F.when(F.count(F.lit(1)).over(w) >= 2, F.when(first == 0, 0.0).otherwise((F.col("close") - first) / first * 100))


def relative_volume_ratio(window: str) -> Column:
    return F.col("volume") / F.nullif(volume_avg(window), F.lit(0.0))


def sma(n: int) -> Column:
    return guard(n, F.avg("close").over(rows(n)))


def true_range() -> Column:
    before = F.lag("close").over(in_order())
    return F.greatest("high", before) - F.least("low", before)


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    return df.withColumn("_tr", true_range()).withColumn(f"atr_{n}", guard(n, F.avg("_tr").over(rows(n)))).drop("_tr")


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = F.avg("close").over(rows(n)), F.stddev_pop("close").over(rows(n))
    return {f"bb_{n}_{k}": guard(n, mid), f"bb_upper_{n}_{k}": guard(n, mid + k * sd), f"bb_lower_{n}_{k}": guard(n, mid - k * sd)}


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    low, high = F.min("low").over(rows(n)), F.max("high").over(rows(n))
    df = df.withColumn("stoch_14_3_3", guard(n, (F.col("close") - low) / F.nullif(high - low, F.lit(0.0)) * 100))
    return df.withColumn("stoch_d_14_3_3", guard(n + smooth - 1, F.avg("stoch_14_3_3").over(rows(smooth))))


class _Smooth:
    """Seeded with the mean of the first n, then y += alpha * (x - y); fed piece by piece."""

    def __init__(self, n: int, alpha: float):
        self.n, self.alpha, self.first, self.last = n, alpha, np.zeros(0), None

    def feed(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        at = 0
        if self.last is None:
            at = self.n - len(self.first)
            self.first = np.r_[self.first, x[:at]]
            if len(self.first) < self.n:
                return out
            self.last = out[at - 1] = float(self.first.mean())
        if at < len(x):
            out[at:] = pd.Series(np.r_[self.last, x[at:]]).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[1:]
            self.last = float(out[-1])
        return out


class _Fold:
    """One symbol's recursive indicators, fed with its closes in order, piece by piece."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.close = names, {}, None

    def state(self) -> str:
        """All that the next piece needs, as text."""
        return json.dumps({"close": self.close, "parts": {k: [p.n, p.alpha, p.first.tolist(), p.last] for k, p in self.parts.items()}})

    @classmethod
    def restored(cls, names: list[str], state: str) -> _Fold:
        fold, held = cls(names), json.loads(state)
        fold.close = held["close"]
        for part, (n, alpha, first, last) in held["parts"].items():
            fold.parts[part] = smooth = _Smooth(n, alpha)
            smooth.first, smooth.last = np.array(first, np.float64), last
        return fold

    def _feed(self, part: str, n: int, alpha: float, x: np.ndarray) -> np.ndarray:
        return self.parts.setdefault(part, _Smooth(n, alpha)).feed(x)

    def feed(self, close: np.ndarray) -> dict[str, np.ndarray]:
        change = np.diff(close) if self.close is None else np.diff(close, prepend=self.close)
        new = self.close is None
        self.close, out, ema = float(close[-1]), {}, {}
        for name in self.names:
            kind, _, n = name.partition("_")
            for m in {"ema": [n], "macd": [12, 26]}.get(kind, []):
                if (m := int(m)) not in ema:
                    ema[m] = self._feed(f"ema{m}", m, 2 / (m + 1), close)
        for name in self.names:
            kind, _, n = name.partition("_")
            if kind == "ema":
                out[name] = ema[int(n)]
            elif kind == "mma":
                out[name] = self._feed(name, int(n), 1 / int(n), close)
            elif kind == "rsi":
                up, down = (self._feed(name + side, int(n), 1 / int(n), np.maximum(x, 0)) for side, x in (("up", change), ("down", -change)))
                with np.errstate(divide="ignore", invalid="ignore"):
                    rsi = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
                out[name] = np.r_[[np.nan] * new, np.where(np.isnan(up), np.nan, rsi)]
            elif name == "macd_12_26_9":
                out[name] = ema[12] - ema[26]
            else:
                line = ema[12] - ema[26]
                signal = np.full(len(line), np.nan)
                signal[~np.isnan(line)] = self._feed(name, 9, 0.2, line[~np.isnan(line)])
                out[name] = signal if name == "macd_signal" else line - signal
        return out


_RECURSIVE = re.compile(r"(?:ema|mma|rsi)_[0-9]+|macd_12_26_9|macd_signal|macd_hist")
RECURSIVE = [*[f"ema_{n}" for n in EMA_PERIODS], *[f"rsi_{n}" for n in RSI_PERIODS], "macd_12_26_9"]


def _known_recursive(names: list[str]) -> list[str]:
    if unknown := [n for n in names if not _RECURSIVE.fullmatch(n)]:
        raise ValueError(f"unknown recursive indicators {unknown}")
    return list(dict.fromkeys(names))


def fold_states(bars: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, us, fold): time and state after each symbol's last bar, with which a stream can go on. Rows stream through
    the fold; an empty history gives no states."""
    own = _known_recursive(names)

    def run(batches):
        now, fold, last = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([last], pa.int64()), pa.array([fold.state()], pa.string())], names=["symbol", "us", "fold"])

        for batch in batches:
            symbols, us, close = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            at = 0
            for symbol, group in itertools.groupby(symbols):
                n = sum(1 for _ in group)
                if fold is None or symbol != now:
                    if fold is not None:
                        yield done()
                    now, fold = symbol, _Fold(own)
                fold.feed(close[at : at + n])
                at += n
                last = us[at - 1]
        if fold is not None:
            yield done()

    return bars.select("symbol", F.unix_micros("ts").alias("us"), F.col("close").cast("double")).repartition("symbol").sortWithinPartitions("symbol", "us").mapInArrow(run, "symbol string, us bigint, fold string")


def with_recursive(bars: DataFrame, names: list[str]) -> DataFrame:
    """bars with the named EMA, MMA, RSI and MACD columns: one fold over each symbol's bars in order, all columns in one
    pass. Rows stream through it; a symbol's state is a few numbers, so a long history takes no memory."""
    own = [n for n in _known_recursive(names) if n not in bars.columns]
    schema = T.StructType([*bars.schema.fields, *[T.StructField(n, T.DoubleType()) for n in own]])

    def run(batches):
        now, fold = None, None
        for batch in batches:
            symbols, close = batch.column("symbol").to_pylist(), batch.column("close").cast(pa.float64()).to_numpy(zero_copy_only=False)
            pieces, at = [], 0
            for symbol, group in itertools.groupby(symbols):
                n = sum(1 for _ in group)
                if fold is None or symbol != now:
                    now, fold = symbol, _Fold(own)
                pieces.append(fold.feed(close[at : at + n]))
                at += n
            made = [np.concatenate([p[name] for p in pieces]) if pieces else np.zeros(0) for name in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.float64(), mask=np.isnan(x)) for x in made]], names=[*batch.schema.names, *own])

    return bars.repartition("symbol").sortWithinPartitions("symbol", "ts").mapInArrow(run, schema) if own else bars


def builders() -> dict[str, Column]:
    """The frame-based indicators by name."""
    out = {}
    for w in ("5m", "15m", "1h"):
        out[f"vwap_{w}"], out[f"volume_avg_{w}"], out[f"relative_volume_ratio_{w}"] = vwap_range(w), volume_avg(w), relative_volume_ratio(w)
    for w in ("1m", "5m", "15m"):
        out[f"price_change_{w}_range_pct"] = price_change_range_pct(w)
    for n in SMA_PERIODS:
        out[f"sma_{n}"] = sma(n)
    return out | bollinger()


def with_indicators(bars: DataFrame, names: list[str]) -> DataFrame:
    """bars with the requested indicators only."""
    fixed = builders() | _registered
    unknown = [n for n in names if n not in fixed and n.split("_")[0] not in ("ema", "mma", "rsi", "macd", "atr", "stoch")]
    if unknown:
        raise ValueError(f"unknown indicators {unknown}")
    if recursive := [n for n in names if n.split("_")[0] in ("ema", "mma", "rsi", "macd")]:
        bars = with_recursive(bars, recursive)
    if any(n.startswith("atr") for n in names):
        bars = atr(bars)
    if any(n.startswith("stoch") for n in names):
        bars = stochastic(bars)
    return bars.withColumns({n: fixed[n] for n in names if n in fixed})


_registered: dict[str, Column] = {}
_told: dict[str, tuple[str, str, str]] = {}


def register_indicator(name: str, column: Column, description: str = "", category: str = "custom", parameters: dict | None = None) -> None:
    """Adds an indicator under a name of its own, with what `catalogue` tells of it."""
    if name in _registered or name in builders():
        raise ValueError(f"indicator {name} exists")
    _registered[name] = column
    _told[name] = description, category, json.dumps(parameters or {}, sort_keys=True)


def _described(name: str) -> tuple[str, str, str]:
    """(description, category, parameters as JSON) of a built-in indicator, told from its name."""
    kind, _, rest = name.partition("_")
    periods = [float(x) if "." in x else int(x) for x in re.findall(r"(?<![a-z0-9.])[0-9]+(?:\.[0-9]+)?(?![a-z0-9.])", rest)]
    window = re.search(r"_([0-9]+[mh])", name)
    what, category = {
        "rsi": ("relative strength index", "momentum"), "ema": ("exponential moving average", "trend"), "sma": ("simple moving average", "trend"), "mma": ("modified moving average", "trend"), "macd": ("moving average convergence and divergence", "momentum"),
        "atr": ("average true range", "volatility"), "bb": ("Bollinger band", "volatility"), "stoch": ("stochastic oscillator", "momentum"), "vwap": ("volume weighted average price", "price"), "volume": ("average volume", "volume"),
        "relative": ("volume over its average", "volume"), "price": ("change of price over a time range", "price"),
    }[kind]
    return what, category, json.dumps({"window": window[1]} if window else {"periods": periods}, sort_keys=True)


def catalogue(spark) -> DataFrame:  # noqa: ANN001
    """name, kind, description, category, parameters of all indicators."""
    recursive = [*RECURSIVE, *[f"mma_{n}" for n in SMA_PERIODS], "macd_signal", "macd_hist"]
    kinds = [(n, "window") for n in [*builders(), "atr_14", "stoch_14_3_3", "stoch_d_14_3_3"]] + [(n, "recursive") for n in recursive]
    rows = [(n, k, *_described(n)) for n, k in kinds] + [(n, "registered", *_told[n]) for n in _registered]
    return spark.createDataFrame(rows, "name string, kind string, description string, category string, parameters string")
