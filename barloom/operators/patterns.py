"""Candle and level patterns over a bar frame, as columns for rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.indicators import in_order
from barloom.operators.frames import today_rows as _today

C = F.col


def _was(name: str) -> Column:
    return F.lag(name).over(in_order())


def _before(n: int):
    return Window.partitionBy("symbol").orderBy("ts").rowsBetween(-n, -1)


def _body() -> Column:
    return F.abs(C("close") - C("open"))


def candle_patterns(n: int = 20, near: float = 0.01, approach: float = 0.005, away: float = 0.01) -> dict[str, Column]:
    """name -> column over bars (symbol, ts, open, high, low, close, volume, et_date)."""
    o, h, low, c = C("open"), C("high"), C("low"), C("close")
    po, ph, pl, pc = _was("open"), _was("high"), _was("low"), _was("close")
    bull, bear, was_bull, was_bear = c > o, c < o, pc > po, pc < po
    top, bottom = F.max("high").over(_before(n)), F.min("low").over(_before(n))
    day_high, day_low = F.max("high").over(_today()), F.min("low").over(_today())
    market_high = F.max(F.when(C("session") == "market", h)).over(_today())
    market_low = F.min(F.when(C("session") == "market", low)).over(_today())
    spike = lambda k: c * 0 + C("volume") / F.nullif(F.avg("volume").over(_before(k)), F.lit(0.0))
    return {
        "lower_shadow_ratio": F.when(_body() > 0, (F.least(o, c) - low) / _body()), "upper_shadow_ratio": F.when(_body() > 0, (h - F.greatest(o, c)) / _body()),
        "bullish_close": bull, "bearish_close": bear,
        "bullish_engulfing": was_bear & bull & (o <= pc) & (c >= po), "bearish_engulfing": was_bull & bear & (o >= pc) & (c <= po),
        "bullish_harami": was_bear & bull & (o >= pc) & (c <= po), "bearish_harami": was_bull & bear & (o <= pc) & (c >= po),
        "inside_bar": (h < ph) & (low > pl), "near_day_high": (day_high - c) / day_high <= near, "near_day_low": (c - day_low) / F.nullif(day_low, F.lit(0.0)) <= near,
        "near_market_high": (market_high - c) / market_high <= near, "near_market_low": (c - market_low) / F.nullif(market_low, F.lit(0.0)) <= near,
        "near_last_high": F.abs(top - c) / top <= near, "near_last_low": F.abs(c - bottom) / F.nullif(bottom, F.lit(0.0)) <= near,
        "break_over_high": c > top, "break_under_low": c < bottom,
        "reject_high": (h >= top * (1 - approach)) & (c <= top * (1 - away)), "reject_low": (low <= bottom * (1 + approach)) & (c >= bottom * (1 + away)),
        "new_candle_high": h > ph, "new_candle_low": low < pl, "volume_spike_2": spike(2), "volume_spike_10": spike(10),
    }


def level_patterns(level: str, near: float = 0.002, away: float = 0.005, n: int = 3) -> dict[str, Column]:
    """Patterns against a level column (VWAP, EMA, open, previous close)."""
    c, pc, x, px = C("close"), _was("close"), C(level), _was(level)
    far = F.max(F.abs(C("close") - C(level)) / C(level)).over(_before(n))
    return {
        f"cross_above_{level}": (pc <= px) & (c > x), f"cross_below_{level}": (pc >= px) & (c < x),
        f"through_{level}": (_body() >= 3 * F.avg(_body()).over(_before(10))) & (F.least("open", "close") < x) & (F.greatest("open", "close") > x),
        f"support_{level}": (F.min("low").over(_before(n)) <= F.lag(level, 1).over(in_order()) * (1 + near)) & (c >= x * (1 + away)),
        f"resistance_{level}": (F.max("high").over(_before(n)) >= F.lag(level, 1).over(in_order()) * (1 - near)) & (c <= x * (1 - away)),
        f"back_to_{level}": (far > away) & (F.abs(c - x) / x < near),
    }


def running_60s(ticks: DataFrame) -> DataFrame:
    """Tick level: price now against the oldest price within 60 seconds, absolute and in percent. Of the ticks of one
    second the first by ts, then seq, is the oldest, in whatever order they come."""
    held = ticks.withColumn("_s", F.unix_seconds("ts")).repartition("symbol")
    held = held.withColumn("_opened", F.first("price").over(Window.partitionBy("symbol", "_s").orderBy("ts", "seq")))
    past = F.first("_opened").over(Window.partitionBy("symbol").orderBy("_s").rangeBetween(-60, 0))
    return held.withColumns({"running_60s": C("price") - past, "running_60s_pct": F.when(past > 0, (C("price") - past) / past * 100)}).drop("_s", "_opened")


def opening_range(bars: DataFrame) -> DataFrame:
    """Breakouts over and under the first market candle of the day."""
    first = bars.filter("session = 'market'").groupBy("symbol", "et_date").agg(F.min_by("high", "ts").alias("range_high"), F.min_by("low", "ts").alias("range_low"), F.min("ts").alias("range_ts"))
    df = bars.join(first, ["symbol", "et_date"], "left")
    after = C("ts") > C("range_ts")
    return df.withColumns({"opening_breakout": F.coalesce(after & (C("close") > C("range_high")), F.lit(False)), "opening_breakdown": F.coalesce(after & (C("close") < C("range_low")), F.lit(False))}).drop("range_ts")
