"""Changes and indicators at timeframes of their own, over coarser bars.

A bar of one minute is final at its evaluation; of a longer timeframe the last whole interval counts, that is the interval
with bars before the one that holds the bar, so no value looks ahead. A day is a date in New York.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import sessions as S
from barloom.operators import bars as B
from barloom.operators import indicators as I

SECONDS = {"1m": 60, "2m": 120, "5m": 300, "10m": 600, "15m": 900, "30m": 1800, "60m": 3600, "2h": 7200, "4h": 14400}
_NAME = re.compile(r"(change_pct|relative_volume|(?:ema|mma|rsi|sma|atr)_[0-9]+)_([0-9]+[mh]|daily)")

#: Intervals whose mean volume `relative_volume` compares with.
RELATIVE_TO = 10
#: The documented ones; any other indicator and timeframe can be asked for by name.
NAMES = [*[f"change_pct_{t}" for t in ("10m", "2h", "4h")], *[f"rsi_14_{t}" for t in ("1m", "2m", "5m", "15m", "daily")], *[f"atr_14_{t}" for t in ("1m", "5m", "daily")]]


def parts(name: str) -> tuple[str, str] | None:
    """(base, timeframe) of a name of this module, else None."""
    found = _NAME.fullmatch(name)
    return found.groups() if found and (found[2] in SECONDS or found[2] == "daily") else None


def _start(timeframe: str) -> Column:
    return S.et_date(F.col("ts")).cast("timestamp") if timeframe == "daily" else B.start_of(F.col("ts"), SECONDS[timeframe])


def with_timeframes(bars: DataFrame, names: list[str]) -> DataFrame:
    """bars with the named columns: for each timeframe one aggregation, its indicators, and an equi-join back."""
    asked: dict[str, list[str]] = {}
    for name in names:
        if not parts(name):
            raise ValueError(f"unknown timeframe metric {name}")
        asked.setdefault(parts(name)[1], []).append(parts(name)[0])
    out = bars
    for timeframe, bases in asked.items():
        indicators = [b for b in bases if b != "change_pct"]
        coarse = I.with_indicators(B.regroup(bars, _start(timeframe)), [b for b in indicators if b != "relative_volume"])
        if "relative_volume" in bases:
            mean = F.nullif(F.avg("volume").over(I.rows(RELATIVE_TO)), F.lit(0.0))
            coarse = coarse.withColumn("relative_volume", I.guard(RELATIVE_TO, F.col("volume") / mean * 100))
        held = lambda c, now=timeframe == "1m": F.col(c) if now else F.lag(c).over(I.in_order())
        made = [held(b).alias(f"{b}_{timeframe}") for b in indicators]
        if "change_pct" in bases:
            made.append(F.lag("close").over(I.in_order()).alias("_before"))
        out = out.withColumn("_start", _start(timeframe)).join(coarse.select("symbol", F.col("ts").alias("_start"), *made), ["symbol", "_start"]).drop("_start")
        if "change_pct" in bases:
            out = out.withColumn(f"change_pct_{timeframe}", F.when(F.col("_before") > 0, (F.col("close") - F.col("_before")) / F.col("_before") * 100)).drop("_before")
    return out
