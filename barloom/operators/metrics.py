"""The metric catalogue: named per-bar metrics as window expressions, computed only when asked for.

Panel mode: every bar is an evaluation point and the current price is its close. Snapshot mode evaluates the same
expressions over final bars and a live bar, one row per symbol.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import sessions as S
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import timeframes as TF
from barloom.operators.frames import BATCH, Frames, RingFrames

C = F.col


def _pct(a: Column, b: Column) -> Column:
    return F.when(b > 0, (a - b) / b * 100)


def _position(low: Column, high: Column) -> Column:
    return F.when(high > low, (C("close") - low) / (high - low) * 100)


def _in(session: str, value: Column) -> Column:
    return F.when(C("session") == session, value)


_DIST = {
    "ma_dist_sma20_daily_pct": "sma_20", "ma_dist_sma10_daily_pct": "sma_10", "ma_dist_sma200_daily_pct": "sma_200", "ma_dist_ema20_1m_pct": "ema_20", "ma_dist_ema9_1m_pct": "ema_9",
    "ma_dist_ema9_5m_pct": "ema_9", "ma_dist_ema9_15m_pct": "ema_9", "ma_dist_ema21_15m_pct": "ema_21", "ma_dist_ema50_15m_pct": "ema_50", "ma_dist_ema9_60m_pct": "ema_9",
    "ma_dist_ema21_60m_pct": "ema_21", "ma_dist_ema50_daily_pct": "ema_50",
}
_NEEDS = {**{k: [v] for k, v in _DIST.items()}, "relative_range_pct": ["atr_14"], **{f"atrp_14_{t}": ["atr_14"] for t in ("1m", "5m", "daily")}}


#: Trading days of the multi-day frames.
_DAYS = {"5d": 5, "10d": 10, "20d": 20, "3m": 63, "6m": 126, "1y": 252}


def _high_low(fr: Frames, days: str) -> tuple[Column, Column]:
    """Highest and lowest price of that many days, today up to this bar included; null while fewer days are there."""
    high, low = fr.held(f"_high_{days}"), fr.held(f"_low_{days}")
    return F.when(high.isNotNull(), F.greatest(high, fr.today("max", "high"))), F.when(low.isNotNull(), F.least(low, fr.today("min", "low")))


def _multi_day(fr: Frames = BATCH) -> dict[str, Callable[[], Column]]:
    def span(d: str) -> Column:
        high, low = _high_low(fr, d)
        return high - low

    def span_pct(d: str) -> Column:
        high, low = _high_low(fr, d)
        return F.when(low > 0, (high - low) / low * 100)

    m: dict[str, Callable[[], Column]] = {f"change_pct_{n}d": lambda n=n: _pct(C("close"), fr.held(f"_close_{n}d")) for n in (2, 5, 10, 20)}
    for d in ("5d", "10d", "20d", "1y"):
        m[f"range_{d}"] = lambda d=d: span(d)
        m[f"range_pct_{d}"] = lambda d=d: span_pct(d)
        m[f"position_in_range_{d}"] = lambda d=d: _position(*reversed(_high_low(fr, d)))
    for d in ("3m", "6m", "1y"):
        m[f"biggest_range_{d}"] = lambda d=d: fr.held(f"_biggest_{d}")
    return m


def _day_columns(order) -> dict[str, Column]:  # noqa: ANN001
    """What the multi-day metrics take from earlier days; unused ones are pruned."""
    full = lambda n, rows, value: F.when(F.count(F.lit(1)).over(rows) >= n, value.over(rows))
    out = {f"_close_{n}d": F.lag("day_close", n).over(order) for n in (2, 5, 10, 20)}
    for d, n in _DAYS.items():
        out[f"_high_{d}"], out[f"_low_{d}"] = (full(n - 1, order.rowsBetween(1 - n, -1), v) for v in (F.max("day_high"), F.min("day_low")))
        out[f"_biggest_{d}"] = full(n, order.rowsBetween(-n, -1), F.max(F.when(C("day_low") > 0, (C("day_high") - C("day_low")) / C("day_low") * 100)))
    return out


def _vwap(fr: Frames, window: str) -> Column:
    volume = fr.seconds("sum", "volume", I.SECONDS[window])
    return F.when(volume == 0, 0.0).otherwise(fr.seconds("sum", "typical_volume", I.SECONDS[window]) / F.nullif(volume, F.lit(0)))


def _change_in(fr: Frames, seconds: int) -> Column:
    first = fr.seconds("first", "close", seconds)
    return F.when(fr.seconds("count", "close", seconds) >= 2, F.when(first == 0, 0.0).otherwise((C("close") - first) / first * 100))


def catalogue(fr: Frames = BATCH) -> dict[str, Callable[[], Column]]:
    """name -> builder over bars with session, et_date, minute_of_day and what `fr` holds: daily references, candles and
    the indicators a metric needs. The frames are windows in batch and state columns on a stream."""
    m: dict[str, Callable[[], Column]] = {"price": lambda: C("close"), "volume_live": lambda: C("volume"), "vwap_live": lambda: F.when(C("volume") > 0, C("vwap"))}
    for name in ("close", "open", "high", "low", "volume", "vwap"):
        m[name] = lambda name=name: C(name)
    for n in (1, 2, 5, 15, 30, 60):
        m[f"price_change_{n}m_pct"] = lambda n=n: _pct(C("close"), fr.lag("close", n))
        m[f"change_{n}m"] = lambda n=n: C("close") - fr.lag("close", n)
    cur = C("close")
    yesterday, opened, closed = (lambda n=n: fr.held(n) for n in ("yesterday_close", "today_open", "today_close"))
    diff = lambda a, b: F.when(b > 0, a - b)
    high, low = (lambda: fr.today("max", "high")), (lambda: fr.today("min", "low"))
    m |= {
        "change_from_close": lambda: diff(cur, yesterday()), "change_from_close_pct": lambda: _pct(cur, yesterday()),
        "change_from_close_premarket": lambda: _in("premarket", diff(cur, yesterday())), "change_from_close_premarket_pct": lambda: _in("premarket", _pct(cur, yesterday())),
        "change_from_close_postmarket": lambda: _in("postmarket", diff(cur, closed())), "change_from_close_postmarket_pct": lambda: _in("postmarket", _pct(cur, closed())),
        "change_from_open": lambda: diff(cur, opened()), "change_from_open_pct": lambda: _pct(cur, opened()), "gap_from_close": lambda: diff(opened(), yesterday()), "gap_from_close_pct": lambda: _pct(opened(), yesterday()),
        "premarket_volume": lambda: fr.today("sum", "premarket"), "postmarket_volume": lambda: fr.today("sum", "postmarket"), "market_volume": lambda: fr.today("sum", "market"),
        "volume_daily": lambda: fr.today("sum", "volume"), "dollar_volume_daily": lambda: fr.today("sum", "dollars"),
        "range_today": lambda: high() - low(), "position_in_range_today": lambda: _position(low(), high()), "range_pct_today": lambda: F.when(low() > 0, (high() - low()) / low() * 100),
        "relative_range_pct": lambda: (high() - low()) / F.nullif(fr.held("atr_14"), F.lit(0.0)) * 100,
        "minutes_in_market": lambda: S.minutes_in_market(C("ts")),
        "relative_volume_same_time": lambda: C("volume") / F.nullif(fr.same_minute("volume", 10), F.lit(0.0)) * 100,
    }
    for n in (1, 2, 5, 10, 15, 30, 60):
        m[f"volume_{n}m"] = lambda n=n: fr.guard(n, fr.rows("sum", "volume", n))
    for n in (1, 5, 15, 60):
        m[f"dollar_volume_{n}m"] = lambda n=n: fr.guard(n, fr.rows("sum", "dollars", n))
    for n in (5, 10, 20):
        m[f"avg_volume_{n}d"] = lambda n=n: fr.held(f"_avg_volume_{n}d")
    for t in ("1m", "2m", "5m", "15m", "daily"):
        m[f"relative_volume_{t}"] = lambda: fr.guard(10, C("volume") / F.nullif(fr.rows("avg", "volume", 10), F.lit(0.0)) * 100)
        m[f"consecutive_candles_{t}"] = lambda: fr.held("_candles").cast("int")
    for n in (2, 5, 10, 15, 30, 60):
        top, bottom = (lambda n=n: fr.rows("max", "high", n)), (lambda n=n: fr.rows("min", "low", n))
        m[f"range_{n}m"] = lambda n=n, a=top, b=bottom: fr.guard(n, a() - b())
        m[f"range_pct_{n}m"] = lambda n=n, a=top, b=bottom: fr.guard(n, F.when(b() > 0, (a() - b()) / b() * 100))
        if n != 10:
            m[f"position_in_range_{n}m"] = lambda n=n, a=top, b=bottom: fr.guard(n, _position(b(), a()))
    for w in ("5m", "15m", "1h"):
        m[f"vwap_dist_{w}"] = lambda w=w: F.when(_vwap(fr, w) > 0, F.abs(cur - _vwap(fr, w)))
        m[f"vwap_dist_{w}_pct"] = lambda w=w: F.when(_vwap(fr, w) > 0, F.abs(cur - _vwap(fr, w)) / _vwap(fr, w) * 100)
    for t in ("1m", "5m", "daily"):
        m[f"atrp_14_{t}"] = lambda: F.when(cur > 0, fr.held("atr_14") / cur * 100)
    for name, ma in _DIST.items():
        m[name] = lambda ma=ma: _pct(cur, fr.held(ma))
    for n in (1, 2, 5, 15, 60):
        m[f"trade_count_{n}m"] = lambda n=n: fr.guard(n, fr.rows("sum", "trade_count", n))
    for name in ("minutes_since_news", "hours_since_news", "days_since_news", "days_until_earnings", *TF.NAMES):
        m[name] = lambda name=name: fr.held(name)
    for n in (1, 5, 15):
        m[f"price_change_{n}m_either_pct"] = lambda n=n: F.coalesce(_pct(C("close"), fr.lag("close", n)), _change_in(fr, 60 * n))
    return m | _multi_day(fr)


_custom: dict[str, tuple[Column, tuple[str, ...]]] = {}


def register_metric(name: str, column: Column, depends: Iterable[str] = ()) -> None:
    """Adds a computed metric over other metrics; it is computed after the ones it depends on."""
    if name in _custom or name in catalogue():
        raise ValueError(f"metric {name} exists")
    _custom[name] = (column, tuple(depends))


def _with_references(bars: DataFrame) -> DataFrame:
    days = B.daily(bars).select("symbol", "et_date", "today_open", "today_close", "yesterday_close", "day_volume", "day_high", "day_low", "day_close")
    order = Window.partitionBy("symbol").orderBy("et_date")
    days = days.withColumns({f"_avg_volume_{n}d": F.when(F.count(F.lit(1)).over(order.rowsBetween(-n, -1)) >= n, F.avg("day_volume").over(order.rowsBetween(-n, -1))) for n in (5, 10, 20)} | _day_columns(order))
    return bars.join(days.drop("day_volume", "day_high", "day_low", "day_close"), ["symbol", "et_date"])


def _with_candles(bars: DataFrame) -> DataFrame:
    """Signed run length of candles of one direction, 100 at most; a candle without a body counts as red."""
    w = I.in_order()
    green = C("close") > C("open")
    df = bars.withColumn("_green", green).withColumn("_turn", F.when(C("_green") != F.lag("_green").over(w), 1).otherwise(0))
    df = df.withColumn("_island", F.sum("_turn").over(w))
    run = F.least(F.row_number().over(Window.partitionBy("symbol", "_island").orderBy("ts")), F.lit(100))
    return df.withColumn("_candles", F.when(C("_green"), run).otherwise(-run)).drop("_green", "_turn", "_island")


_DAILY = {"change_from_close", "change_from_open", "gap_from_close", "avg_volume"}


def _in_order_of_need(names: list[str]) -> list[str]:
    """The registered metrics among names and their dependencies, each after those it depends on."""
    done: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"metrics depend on each other: {' > '.join((*above, name))}")
        if name in _custom and name not in done:
            for d in _custom[name][1]:
                visit(d, (*above, name))
            done.append(name)

    for name in names:
        visit(name, ())
    return done


#: Metrics whose names tell a timeframe, as formulas over that timeframe's own indicators: name -> (indicator, formula).
_AT = {"ma_dist": lambda held: _pct(C("close"), held), "atrp": lambda held: F.when(C("close") > 0, held / C("close") * 100), "relative_volume": lambda held: held}


def own_frame(name: str) -> tuple[str, Callable[[Column], Column]] | None:
    """(the timeframe's indicator, the metric from it), for a metric that one formula serves at all timeframes; else None."""
    if name == "relative_range_pct":
        return "atr_14_daily", lambda held: (BATCH.today("max", "high") - BATCH.today("min", "low")) / F.nullif(held, F.lit(0.0)) * 100
    if found := re.fullmatch(r"ma_dist_(ema|sma)([0-9]+)_([0-9]+m|daily)_pct", name):
        return f"{found[1]}_{found[2]}_{found[3]}", _AT["ma_dist"]
    if found := re.fullmatch(r"atrp_14_([0-9]+m|daily)", name):
        return f"atr_14_{found[1]}", _AT["atrp"]
    return (name, _AT["relative_volume"]) if re.fullmatch(r"relative_volume_([0-9]+[mh]|daily)", name) else None


def with_metrics(bars: DataFrame, names: list[str], events: DataFrame | None = None, own_frames: bool = False, ring: int | None = None) -> DataFrame:
    """bars with the named metrics only. events(symbol, event_ts, kind) feeds the news and earnings metrics.

    own_frames: `ma_dist_*`, `atrp_14_*`, `relative_volume_*` and `relative_range_pct` are computed at the timeframe that
    their name tells (a day for the last), from its last whole interval; without it from the bars at hand, whatever the name
    says. ring: day metrics (`volume_daily`, `dollar_volume_daily`, `*_today`) over the last so many bars instead of the day;
    session volumes stay the day's."""
    if own_frames and (at := {n: own_frame(n) for n in names if own_frame(n)}):
        rest = [n for n in names if n not in at]
        held = {n: f"_at_{i}" for i, n in enumerate(at)}
        framed = TF.with_timeframes(bars.withColumn("et_date", S.et_date(C("ts"))), list(dict.fromkeys(x for x, _ in at.values())))
        framed = framed.withColumns({held[n]: made(C(x)) for n, (x, made) in at.items()}).select(*bars.columns, *held.values())
        out = with_metrics(framed, rest, events, ring=ring)
        return out.withColumnsRenamed({c: n for n, c in held.items()}).select(*bars.columns, "session", "et_date", *names)
    own = _in_order_of_need(names)
    names = list(dict.fromkeys([d for n in own for d in _custom[n][1] if d not in _custom] + [n for n in names if n not in _custom]))
    base = catalogue(RingFrames(ring) if ring else BATCH)
    framed = [n for n in names if TF.parts(n) and (n in TF.NAMES or n not in base)]
    made = base | {n: lambda n=n: C(n) for n in framed}
    if unknown := [n for n in names if n not in made]:
        raise ValueError(f"unknown metrics {unknown}")
    keep = bars.columns
    df = bars.withColumn("session", S.market_session(C("ts"))).withColumn("et_date", S.et_date(C("ts"))).withColumn("minute_of_day", S.minute_of_day(C("ts")))
    if framed:
        df = TF.with_timeframes(df, framed)
    if needs := sorted({x for n in names for x in _NEEDS.get(n, [])}):
        df = I.with_indicators(df, needs)
    if any(n.startswith(tuple(_DAILY)) or n in _multi_day() for n in names):
        df = _with_references(df)
    if any(n.startswith("consecutive") for n in names):
        df = _with_candles(df)
    if kinds := tuple(k for k in ("news", "earnings") if any(n.endswith(k) for n in names)):
        df = with_event_metrics(df, events, kinds)
    new = {n: made[n]() for n in names if n not in keep}
    df = df.withColumns(new)
    for n in own:
        df = df.withColumn(n, _custom[n][0])
    return df.select(*keep, "session", "et_date", *[n for n in [*names, *own] if n not in keep])


#: A part of the as-of join: no task reads more of a symbol than its rows of so many seconds.
ASOF_SECONDS = 86400


def _last_event(df: DataFrame, kind: str, forward: bool, seconds: int) -> DataFrame:
    """df with `_{kind}`, the second of the last event of the kind up to each row (forward: of the first from it on).

    An event in the row's own stretch of time is found by a window over that stretch; what earlier stretches (later ones)
    hand on is one row each, so only those are ordered by symbol as a whole."""
    sign = -1 if forward else 1
    at, part = F.unix_seconds("ts") * sign, F.floor(F.unix_seconds("ts") / seconds) * sign
    keyed = df.withColumns({"_at": at, "_part": part, "_stamp": F.when(C("_event") & (C("kind") == kind), at)})
    within = Window.partitionBy("symbol", "_part").orderBy("_at", C("_event").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ends = keyed.groupBy("symbol", "_part").agg(F.max("_stamp").alias("_end"))
    before = Window.partitionBy("symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("symbol", "_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    found = keyed.withColumn("_own", F.last("_stamp", ignorenulls=True).over(within)).join(carried, ["symbol", "_part"], "left")
    return found.withColumn(f"_{kind}", F.coalesce("_own", "_carried") * sign).drop("_at", "_part", "_stamp", "_own", "_carried")


def with_event_metrics(df: DataFrame, events: DataFrame, kinds: tuple[str, ...] = ("news", "earnings"), seconds: int = ASOF_SECONDS) -> DataFrame:
    """As-of joins by union and fill: minutes, hours and days since news (backward), days until earnings (forward)."""
    marks = events.filter("symbol is not null and event_ts is not null").select("symbol", C("event_ts").alias("ts"), F.lit(True).alias("_event"), "kind")
    both = df.withColumn("_event", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    for kind in kinds:
        both = _last_event(both, kind, kind == "earnings", seconds)
    if "news" in kinds:
        since = F.unix_seconds("ts") - C("_news")
        within = {"minutes": (86400, 60), "hours": (86400, 3600), "days": (3 * 86400, 86400)}
        both = both.withColumns({f"{unit}_since_news": F.when(since <= most, since / one) for unit, (most, one) in within.items()})
    if "earnings" in kinds:
        both = both.withColumn("days_until_earnings", (C("_earnings") - F.unix_seconds("ts")) / 86400)
    return both.filter(~C("_event")).drop("_event", "kind", *[f"_{k}" for k in kinds])


def with_fundamentals(df: DataFrame, fundamentals: DataFrame, volume: str = "avg_volume_20d") -> DataFrame:
    """Symbol attributes by a left join; Spark broadcasts the table when its size allows. Where they hold shares_short and
    df the average daily volume, short_ratio is the former over the latter: the days that covering would take."""
    out = df.join(fundamentals, "symbol", "left")
    if "shares_short" in fundamentals.columns and volume in df.columns and "short_ratio" not in out.columns:
        out = out.withColumn("short_ratio", F.col("shares_short") / F.nullif(F.col(volume).cast("double"), F.lit(0.0)))
    return out


def snapshot(ticks: DataFrame, at, names: list[str], events: DataFrame | None = None) -> DataFrame:
    """One row per symbol as of an instant: the final bars and the live bar as the last evaluation point.

    All ticks up to the instant count, so that day values, references to earlier days and recursive indicators are those of
    the panel at that bar; give ticks from some instant on where only frames of bounded length are asked for.
    """
    now = F.lit(at).cast("timestamp")
    final = B.ticks_to_bars(ticks.filter(C("ts") < B.start_of(now, 60)))
    both = final.unionByName(B.live_bars(ticks, at))
    return B.latest_bars(with_metrics(both, names, events), 1)


def unpivot(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Long form (symbol, ts, metric, value)."""
    return metrics.select("symbol", "ts", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), C(n).cast("double").alias("value")) for n in names])).alias("x")).select("symbol", "ts", "x.*").filter("value is not null")
