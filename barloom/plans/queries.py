"""The registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import sessions as S
from barloom.operators import alerts as A
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import metrics as M
from barloom.operators import patterns as P
from barloom.operators import prefix as PX
from barloom.operators import rule_index as RI
from barloom.operators import rules as R
from barloom.operators import toplists as K
from barloom.sources import normalize as N
from barloom.sources import sinks
from barloom.sources import ticks as T

QUERIES, ORACLES = {}, {}
TS = "%Y-%m-%d %H:%M:%S"
#: Added before rounding, so that halves fall the same way whatever the order of a sum.
NUDGE = 1e-9


def final(df: DataFrame, *cols: str) -> DataFrame:
    """The columns, with timestamps as text and doubles rounded, as the SQL has them."""
    kinds = dict(df.dtypes)
    made = {"timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "date": lambda c: F.col(c).cast("string"), "double": lambda c: F.round(F.col(c) + NUDGE, 6)}
    return df.select(*[made[kinds[c]](c).alias(c) if kinds[c] in made else F.col(c) for c in cols])


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def by_user(spark: SparkSession, sf: str) -> DataFrame:
    return T.ticks_from_events(spark, sf)


def user_bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.ticks_to_bars(by_user(spark, sf))


def hour_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars by event type: five symbols, many ticks a bar."""
    return B.ticks_to_bars(T.ticks_from_events(spark, sf, "event_type"), 3600)


def day_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars by part: many symbols, hardly two ticks a bar."""
    return B.ticks_to_bars(B.dealt(T.ticks_from_lineitem(spark, sf)), 86400)


# SQL parts ------------------------------------------------------------------------------------------------------------
_AGG = """first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
 sum(size)::BIGINT AS volume, CASE WHEN sum(size) = 0 THEN 0 ELSE sum(price * size) / sum(size) END AS vwap, count(*)::BIGINT AS trade_count"""
_NY = "timezone('America/New_York', timezone('UTC', ts))"
_MIN = f"(hour({_NY}) * 60 + minute({_NY}))"
_SESSION = f"""CASE WHEN isodow({_NY}) > 5 THEN 'closed' WHEN {_MIN} >= 240 AND {_MIN} < 570 THEN 'premarket' WHEN {_MIN} >= 570 AND {_MIN} < 960 THEN 'market'
 WHEN {_MIN} >= 960 AND {_MIN} < 1200 THEN 'postmarket' ELSE 'closed' END"""


def _ticks(symbol: str) -> str:
    return f"ticks AS (SELECT {symbol}::VARCHAR AS symbol, ts, event_id AS seq, value AS price, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS size FROM events WHERE value > 0)"


def _bars(symbol: str = "user_id", unit: str = "minute") -> str:
    return f"{_ticks(symbol)}, b0 AS (SELECT symbol, date_trunc('{unit}', ts) AS bar, {_AGG} FROM ticks GROUP BY ALL), bars AS (SELECT symbol, bar AS ts, open, high, low, close, volume, vwap, trade_count FROM b0), x AS (SELECT *, {_SESSION} AS session, {_NY}::DATE AS et_date, floor(epoch(ts))::BIGINT AS s FROM bars)"


USER, HOUR = _bars(), _bars("event_type", "hour")
DAYS = f"ticks AS (SELECT l_partkey::VARCHAR AS symbol, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice / l_quantity AS price, l_quantity::BIGINT AS size FROM lineitem), b0 AS (SELECT symbol, date_trunc('day', ts) AS bar, {_AGG} FROM ticks GROUP BY ALL), bars AS (SELECT symbol, bar AS ts, open, high, low, close, volume, vwap, trade_count FROM b0), x AS (SELECT *, {_SESSION} AS session, {_NY}::DATE AS et_date, floor(epoch(ts))::BIGINT AS s FROM bars)"
REFS = """d0 AS (SELECT symbol, et_date, first(open ORDER BY ts) AS today_open, sum(volume)::BIGINT AS day_volume, max(high) AS day_high, min(low) AS day_low, last(close ORDER BY ts) AS day_close,
 coalesce(last(close ORDER BY ts) FILTER (session = 'market'), first(close ORDER BY ts) FILTER (session = 'postmarket')) AS today_close FROM x GROUP BY ALL),
d AS (SELECT *, last_value(today_close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY et_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS yesterday_close FROM d0),
y AS (SELECT x.*, today_open, today_close, yesterday_close FROM x JOIN d USING (symbol, et_date))"""
STAMP = f"strftime(ts, '{TS}') AS ts"


def W(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def RANGE(secs: int) -> str:
    return f"(PARTITION BY symbol ORDER BY s RANGE BETWEEN {secs} PRECEDING AND CURRENT ROW)"


DAY, ORD = "(PARTITION BY symbol, et_date ORDER BY ts)", "(PARTITION BY symbol ORDER BY ts)"


def G(n: int, e: str) -> str:
    return f"CASE WHEN count(*) OVER {W(n)} >= {n} THEN {e} END"


def r6(e: str) -> str:
    return f"round(({e})::DOUBLE + {NUDGE}, 6)"


def sql(prelude: str, cols: dict[str, str], source: str = "x", where: str = "") -> str:
    return f"WITH {prelude} SELECT symbol, {STAMP}, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {source} {where}"


def metric_query(name: str, exprs: dict[str, str], frame=user_bars, prelude: str = USER, source: str = "x", whole: tuple[str, ...] = ()) -> None:  # noqa: ANN001
    """A query of metrics over a bar frame. exprs: metric -> SQL; whole: those that are whole numbers."""
    query(name, sql(prelude, {c: e if c in whole else r6(e) for c, e in exprs.items()}, source))(lambda spark, sf: final(M.with_metrics(frame(spark, sf), list(exprs)), "symbol", "ts", *exprs))


OHLCV = {**{c: r6(c) for c in ("open", "high", "low", "close")}, "volume": "volume", "vwap": r6("vwap"), "trade_count": "trade_count"}
BAR = ["symbol", "ts", *OHLCV]

# Bars and bar queries -------------------------------------------------------------------------------------------------
query("bars_1m", sql(USER, OHLCV))(lambda s, d: final(user_bars(s, d), *BAR))
query("bars_1h_by_type", sql(HOUR, OHLCV))(lambda s, d: final(hour_bars(s, d), *BAR))
query("bars_resampled_4h", f"WITH {HOUR}, z AS (SELECT symbol, to_timestamp(s - s % 14400)::TIMESTAMP AS bar, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume)::BIGINT AS volume, CASE WHEN sum(volume) = 0 THEN 0 ELSE sum(vwap * volume) / sum(volume) END AS vwap, sum(trade_count)::BIGINT AS trade_count FROM x GROUP BY ALL), q AS (SELECT * EXCLUDE (bar), bar AS ts FROM z) SELECT symbol, {STAMP}, {', '.join(f'{e} AS {c}' for c, e in OHLCV.items())} FROM q".replace("to_timestamp(s - s % 14400)::TIMESTAMP", "make_timestamp((s - s % 14400) * 1000000)"))(lambda s, d: final(B.resample(hour_bars(s, d), 14400), *BAR))
AT = "2024-01-15 14:30:40"
query("live_bar_asof", f"WITH {_ticks('event_type')}, b0 AS (SELECT symbol, date_trunc('hour', ts) AS bar, {_AGG} FROM ticks WHERE ts <= '{AT}' AND ts >= '2024-01-15 14:00:00' GROUP BY ALL), x AS (SELECT * EXCLUDE (bar), bar AS ts FROM b0) SELECT symbol, {STAMP}, {', '.join(f'{e} AS {c}' for c, e in OHLCV.items())} FROM x")(
    lambda s, d: final(B.live_bars(T.ticks_from_events(s, d, "event_type"), AT, 3600), *BAR)
)
query("bars_range", sql(HOUR, OHLCV, where="WHERE symbol = 'click' AND ts BETWEEN '2024-01-05' AND '2024-01-09'"))(lambda s, d: final(B.bars_in_range(hour_bars(s, d), "click", "2024-01-05", "2024-01-09"), *BAR))
query("bars_latest_n", sql(USER, OHLCV, where="QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 3"))(lambda s, d: final(B.latest_bars(user_bars(s, d), 3), *BAR))
query("bars_upsert", f"WITH {HOUR} SELECT symbol, {STAMP}, {r6('close')} AS close, CASE WHEN symbol = 'click' THEN 0 ELSE volume END AS volume FROM x")(
    lambda s, d: final(sinks.upsert(hour_bars(s, d), hour_bars(s, d).filter("symbol = 'click'").withColumn("volume", F.lit(0).cast("long")), ["symbol", "ts"]), "symbol", "ts", "close", "volume")
)
query("quarantine", "SELECT CASE WHEN value > 0 THEN 'valid' ELSE 'price not positive' END AS reason, count(*)::BIGINT AS n FROM events GROUP BY ALL")(lambda s, d: by_user(s, d).groupBy(F.coalesce(T.tick_fault(), F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n")))
query("symbol_search", "SELECT DISTINCT user_id::VARCHAR AS symbol FROM events WHERE user_id::VARCHAR LIKE '%12%'")(lambda s, d: B.search_symbols(by_user(s, d), "12"))
query("latest_values", sql(USER, {"close": r6("close")}, where="QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1 AND s > epoch(TIMESTAMP '2024-01-30 00:00:00') - 86400"))(lambda s, d: final(sinks.latest_values(user_bars(s, d), "2024-01-30 00:00:00", 86400), "symbol", "ts", "close"))

# Sessions and daily references ----------------------------------------------------------------------------------------
_OPENED = f"epoch(timezone('UTC', timezone('America/New_York', ({_NY}::DATE)::TIMESTAMP + INTERVAL 570 MINUTE)))::BIGINT"
query("session_label", f"SELECT event_id, {_SESSION} AS session FROM events")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", S.market_session(F.col("ts").cast("timestamp")).alias("session")))
query("session_volume", sql(USER, {"premarket_volume": f"sum(CASE WHEN session = 'premarket' THEN volume ELSE 0 END) OVER {DAY}::BIGINT", "postmarket_volume": f"sum(CASE WHEN session = 'postmarket' THEN volume ELSE 0 END) OVER {DAY}::BIGINT", "market_volume": f"sum(CASE WHEN session = 'market' THEN volume END) OVER {DAY}::BIGINT"}).replace(f"OVER {DAY}::BIGINT", f"OVER {DAY}"))(
    lambda s, d: final(M.with_metrics(user_bars(s, d), ["premarket_volume", "postmarket_volume", "market_volume"]), "symbol", "ts", "premarket_volume", "postmarket_volume", "market_volume")
)
query("daily_refs", f"WITH {USER}, {REFS} SELECT symbol, et_date::VARCHAR AS et_date, {r6('today_open')} AS today_open, {r6('today_close')} AS today_close, {r6('yesterday_close')} AS yesterday_close, {r6('day_high')} AS day_high, day_volume FROM d")(
    lambda s, d: final(B.daily(user_bars(s, d)), "symbol", "et_date", "today_open", "today_close", "yesterday_close", "day_high", "day_volume")
)
query("minutes_in_market", sql(USER, {"minutes_in_market": f"CASE WHEN isodow({_NY}) <= 5 AND floor((s - {_OPENED}) / 60.0) > 0 THEN floor((s - {_OPENED}) / 60.0)::BIGINT END", "since_open": f"CASE WHEN session = 'closed' THEN 0 ELSE greatest(floor((s - {_OPENED}) / 60.0)::BIGINT, 0) END"}))(
    lambda s, d: final(M.with_metrics(user_bars(s, d), ["minutes_in_market"]).withColumn("since_open", S.minutes_since_market_open(F.col("ts"))), "symbol", "ts", "minutes_in_market", "since_open")
)

# Metrics --------------------------------------------------------------------------------------------------------------
NS = (1, 2, 5, 15, 30, 60)
pct = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a} - {b}) / {b} * 100 END"
metric_query("price_change_pct", {f"price_change_{n}m_pct": pct("close", f"lag(close, {n}) OVER {ORD}") for n in NS})
metric_query("change_abs", {f"change_{n}m": f"close - lag(close, {n}) OVER {ORD}" for n in NS})
dif = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} - {b} END"
ON = lambda session, e: f"CASE WHEN session = '{session}' THEN {e} END"
WITH_REFS = f"{USER}, {REFS}"
metric_query("change_from_close", {"change_from_close": dif("close", "yesterday_close"), "change_from_close_pct": pct("close", "yesterday_close")}, prelude=WITH_REFS, source="y")
metric_query("change_from_close_sessions", {
    "change_from_close_premarket": ON("premarket", dif("close", "yesterday_close")), "change_from_close_premarket_pct": ON("premarket", pct("close", "yesterday_close")),
    "change_from_close_postmarket": ON("postmarket", dif("close", "today_close")), "change_from_close_postmarket_pct": ON("postmarket", pct("close", "today_close")),
}, prelude=WITH_REFS, source="y")
metric_query("change_from_open", {"change_from_open": dif("close", "today_open"), "change_from_open_pct": pct("close", "today_open")}, prelude=WITH_REFS, source="y")
metric_query("gap_from_close", {"gap_from_close": dif("today_open", "yesterday_close"), "gap_from_close_pct": pct("today_open", "yesterday_close")}, prelude=WITH_REFS, source="y")
VOLUMES = {f"volume_{n}m": G(n, f"sum(volume) OVER {W(n)}") for n in (1, 2, 5, 10, 15, 30, 60)}
metric_query("volume_n", {c: f"({e})::BIGINT" for c, e in VOLUMES.items()}, whole=tuple(VOLUMES))
USD = "(CASE WHEN vwap > 0 THEN vwap ELSE close END * volume)"
metric_query("dollar_volume_n", {f"dollar_volume_{n}m": G(n, f"sum({USD}) OVER {W(n)}") for n in (1, 5, 15, 60)})
metric_query("volume_daily", {"volume_daily": f"(sum(volume) OVER {DAY})::BIGINT", "dollar_volume_daily": f"sum({USD}) OVER {DAY}"}, whole=("volume_daily",))
_AVG = "avg(day_volume) OVER (PARTITION BY symbol ORDER BY et_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
metric_query("avg_volume_nd", {f"avg_volume_{n}d": f"_a{n}" for n in (5, 10, 20)}, day_bars, f"{DAYS}, {REFS}, e AS (SELECT symbol, et_date, " + ", ".join(f"CASE WHEN {_AVG.format(n=n).replace('avg(day_volume)', 'count(*)')} >= {n} THEN {_AVG.format(n=n)} END AS _a{n}" for n in (5, 10, 20)) + " FROM d), z AS (SELECT x.symbol, x.ts, _a5, _a10, _a20 FROM x JOIN e USING (symbol, et_date))", "z")
metric_query("relative_volume", {f"relative_volume_{t}": G(10, f"volume / nullif(avg(volume) OVER {W(10)}, 0) * 100") for t in ("1m", "2m", "5m", "15m", "daily")})
metric_query("relative_volume_same_time", {"relative_volume_same_time": f"volume / nullif(avg(volume) OVER (PARTITION BY symbol, {_MIN} ORDER BY et_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) * 100"}, hour_bars, HOUR)
HI, LO = (lambda w: f"max(high) OVER {w}"), (lambda w: f"min(low) OVER {w}")
RN = (2, 5, 10, 15, 30, 60)
metric_query("range_n", {f"range_{n}m": G(n, f"{HI(W(n))} - {LO(W(n))}") for n in RN})
metric_query("range_pct_n", {f"range_pct_{n}m": G(n, f"CASE WHEN {LO(W(n))} > 0 THEN ({HI(W(n))} - {LO(W(n))}) / {LO(W(n))} * 100 END") for n in RN})
metric_query("range_today", {"range_today": f"{HI(DAY)} - {LO(DAY)}", "range_pct_today": f"CASE WHEN {LO(DAY)} > 0 THEN ({HI(DAY)} - {LO(DAY)}) / {LO(DAY)} * 100 END"})
POS = lambda w: f"CASE WHEN {HI(w)} > {LO(w)} THEN (close - {LO(w)}) / ({HI(w)} - {LO(w)}) * 100 END"
metric_query("position_in_range", {**{f"position_in_range_{n}m": G(n, POS(W(n))) for n in (2, 5, 15, 30, 60)}, "position_in_range_today": POS(DAY)})
_DAYS = {"5d": 5, "10d": 10, "20d": 20}
_PAST = "(PARTITION BY symbol ORDER BY et_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
_FULL = lambda n, e: f"CASE WHEN count(*) OVER {_PAST.format(n=n)} >= {n} THEN {e} OVER {_PAST.format(n=n)} END"
MULTI = f"{WITH_REFS}, e AS (SELECT symbol, et_date, " + ", ".join(
    [f"lag(day_close, {n}) OVER (PARTITION BY symbol ORDER BY et_date) AS c{n}" for n in (2, 5, 10, 20)] + [f"{_FULL(n - 1, 'max(day_high)')} AS h{d}, {_FULL(n - 1, 'min(day_low)')} AS l{d}" for d, n in _DAYS.items()]
) + f" FROM d), w AS (SELECT x.*, {HI(DAY)} AS dh, {LO(DAY)} AS dl, e.* EXCLUDE (symbol, et_date) FROM x JOIN e USING (symbol, et_date)), z AS (SELECT *, " + ", ".join(f"CASE WHEN h{d} IS NOT NULL THEN greatest(h{d}, dh) END AS hi{d}, CASE WHEN l{d} IS NOT NULL THEN least(l{d}, dl) END AS lo{d}" for d in _DAYS) + " FROM w)"
metric_query("change_pct_days", {f"change_pct_{n}d": pct("close", f"c{n}") for n in (2, 5, 10, 20)}, prelude=MULTI, source="z")
metric_query("range_days", {"range_5d": "hi5d - lo5d", "range_10d": "hi10d - lo10d", "range_pct_20d": "CASE WHEN lo20d > 0 THEN (hi20d - lo20d) / lo20d * 100 END", **{f"position_in_range_{d}": f"CASE WHEN hi{d} > lo{d} THEN (close - lo{d}) / (hi{d} - lo{d}) * 100 END" for d in _DAYS}}, prelude=MULTI, source="z")
ATR = f"t0 AS (SELECT *, greatest(high, coalesce(lag(close) OVER {ORD}, high)) - least(low, coalesce(lag(close) OVER {ORD}, low)) AS tr FROM x), t AS (SELECT *, {G(14, f'avg(tr) OVER {W(14)}')} AS atr_14 FROM t0)"
metric_query("relative_range", {"relative_range_pct": f"({HI(DAY)} - {LO(DAY)}) / nullif(atr_14, 0) * 100"}, hour_bars, f"{HOUR}, {ATR}", "t")
metric_query("atrp", {f"atrp_14_{t}": "CASE WHEN close > 0 THEN atr_14 / close * 100 END" for t in ("1m", "5m", "daily")}, prelude=f"{USER}, {ATR}", source="t")
VW = lambda secs: f"CASE WHEN sum(volume) OVER {RANGE(secs)} = 0 THEN 0 ELSE sum((high + low + close) / 3 * volume) OVER {RANGE(secs)} / nullif(sum(volume) OVER {RANGE(secs)}, 0) END"
LONG = {"5m": 300, "15m": 900, "1h": 3600}


def _indicators(name: str, exprs: dict[str, str], frame=user_bars, prelude: str = USER, source: str = "x") -> None:  # noqa: ANN001
    query(name, sql(prelude, {c: r6(e) for c, e in exprs.items()}, source))(lambda s, d: final(I.with_indicators(frame(s, d), list(exprs)), "symbol", "ts", *exprs))


_indicators("vwap_range", {**{f"vwap_{w}": VW(n) for w, n in LONG.items()}, **{f"volume_avg_{w}": f"avg(volume) OVER {RANGE(n)}" for w, n in LONG.items()}, **{f"relative_volume_ratio_{w}": f"volume / nullif(avg(volume) OVER {RANGE(n)}, 0)" for w, n in LONG.items()}}, hour_bars, HOUR)
FIRST = lambda n: f"first_value(close) OVER {RANGE(n)}"
_indicators("price_change_range", {f"price_change_{w}_range_pct": f"CASE WHEN count(*) OVER {RANGE(n)} >= 2 THEN CASE WHEN {FIRST(n)} = 0 THEN 0 ELSE (close - {FIRST(n)}) / {FIRST(n)} * 100 END END" for w, n in {"1m": 60, "5m": 300, "15m": 900}.items()})
VD = f"{HOUR}, v AS (SELECT *, " + ", ".join(f"{VW(n)} AS v{w}" for w, n in LONG.items()) + " FROM x)"
metric_query("vwap_dist", {**{f"vwap_dist_{w}": f"CASE WHEN v{w} > 0 THEN abs(close - v{w}) END" for w in LONG}, **{f"vwap_dist_{w}_pct": f"CASE WHEN v{w} > 0 THEN abs(close - v{w}) / v{w} * 100 END" for w in LONG}}, hour_bars, VD, "v")
SMA = lambda n: G(n, f"avg(close) OVER {W(n)}")
_indicators("sma", {f"sma_{n}": SMA(n) for n in (10, 20, 50, 200)}, hour_bars, HOUR)
metric_query("ma_dist", {f"ma_dist_sma{n}_daily_pct": pct("close", f"m{n}") for n in (10, 20, 200)}, hour_bars, f"{HOUR}, m AS (SELECT *, {', '.join(f'{SMA(n)} AS m{n}' for n in (10, 20, 200))} FROM x)", "m")
query("atr_bb_stoch", f"WITH {HOUR}, {ATR}, z AS (SELECT *, {SMA(20)} AS mid, {G(20, f'stddev_pop(close) OVER {W(20)}')} AS sd, {G(14, f'(close - {LO(W(14))}) / nullif({HI(W(14))} - {LO(W(14))}, 0) * 100')} AS k FROM t) SELECT symbol, {STAMP}, {r6('atr_14')} AS atr_14, {r6('mid')} AS bb_mid, {r6('mid + 2 * sd')} AS bb_upper, {r6('mid - 2 * sd')} AS bb_lower, {r6('k')} AS stoch_k, {r6(G(16, f'avg(k) OVER {W(3)}'))} AS stoch_d FROM z")(
    lambda s, d: final(I.with_indicators(hour_bars(s, d), ["atr_14", "stoch_14_3_3", *I.bollinger()]).withColumnsRenamed({"bb_20_2.0": "bb_mid", "bb_upper_20_2.0": "bb_upper", "bb_lower_20_2.0": "bb_lower", "stoch_14_3_3": "stoch_k", "stoch_d_14_3_3": "stoch_d"}), "symbol", "ts", "atr_14", "bb_mid", "bb_upper", "bb_lower", "stoch_k", "stoch_d")
)
metric_query("trade_count", {f"trade_count_{n}m": f"({G(n, f'sum(trade_count) OVER {W(n)}')})::BIGINT" for n in (1, 2, 5, 15, 60)}, hour_bars, HOUR, whole=tuple(f"trade_count_{n}m" for n in (1, 2, 5, 15, 60)))
RUN = f"c0 AS (SELECT *, close > open AS green FROM x), c1 AS (SELECT *, CASE WHEN green <> lag(green) OVER {ORD} THEN 1 ELSE 0 END AS turn FROM c0), c2 AS (SELECT *, sum(turn) OVER {ORD} AS island FROM c1), c AS (SELECT *, least(row_number() OVER (PARTITION BY symbol, island ORDER BY ts), 100)::INTEGER AS run FROM c2)"
_CANDLES = tuple(f"consecutive_candles_{t}" for t in ("1m", "2m", "5m", "15m", "daily"))
metric_query("consecutive_candles", dict.fromkeys(_CANDLES, "CASE WHEN green THEN run ELSE -run END"), hour_bars, f"{HOUR}, {RUN}", "c", whole=_CANDLES)

# Recursive indicators -------------------------------------------------------------------------------------------------


def _ema_sql(name: str, n: int, alpha: str, value: str = "close", source: str = "q") -> str:
    return f"{name} AS (SELECT symbol, ts, rn, (SELECT avg({value}) FROM {source} p WHERE p.symbol = o.symbol AND p.rn <= {n}) AS v FROM {source} o WHERE rn = {n} UNION ALL SELECT o.symbol, o.ts, o.rn, e.v + {alpha} * (o.{value} - e.v) FROM {name} e JOIN {source} o ON o.symbol = e.symbol AND o.rn = e.rn + 1)"


NUMBERED = f"q AS (SELECT *, row_number() OVER {ORD} AS rn FROM x)"
query("ema", f"WITH RECURSIVE {USER}, {NUMBERED}, {_ema_sql('e9', 9, '2.0 / 10')}, {_ema_sql('e21', 21, '2.0 / 22')} SELECT q.symbol, strftime(q.ts, '{TS}') AS ts, {r6('e9.v')} AS ema_9, {r6('e21.v')} AS ema_21 FROM q LEFT JOIN e9 USING (symbol, rn) LEFT JOIN e21 USING (symbol, rn)")(lambda s, d: final(I.with_indicators(user_bars(s, d), ["ema_9", "ema_21"]), "symbol", "ts", "ema_9", "ema_21"))
query("ema_two_level", f"WITH RECURSIVE {HOUR}, {NUMBERED}, {_ema_sql('e9', 9, '2.0 / 10')} SELECT symbol, {STAMP}, {r6('v')} AS ema_9 FROM e9")(lambda s, d: final(PX.with_recursive_chunked(hour_bars(s, d), ["ema_9"], 4 * 86400).filter("ema_9 is not null"), "symbol", "ts", "ema_9"))
_LINE = "line AS (SELECT symbol, ts, e12.v - e26.v AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM e12 JOIN e26 USING (symbol, ts))"
query("recursive_chunked", f"WITH RECURSIVE {HOUR}, {NUMBERED}, {_ema_sql('e12', 12, '2.0 / 13')}, {_ema_sql('e26', 26, '2.0 / 27')}, {_ema_sql('m20', 20, '1.0 / 20')}, {_LINE}, {_ema_sql('sg', 9, '0.2', 'close', 'line')}, g0 AS (SELECT *, close - lag(close) OVER {ORD} AS ch FROM x), g AS (SELECT symbol, ts, greatest(ch, 0) AS up, greatest(-ch, 0) AS dn, row_number() OVER {ORD} AS rn FROM g0 WHERE ch IS NOT NULL), {_ema_sql('u', 14, '1.0 / 14', 'up', 'g')}, {_ema_sql('v', 14, '1.0 / 14', 'dn', 'g')} SELECT symbol, strftime(q.ts, '{TS}') AS ts, {r6('m20.v')} AS mma_20, {r6('CASE WHEN v.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / v.v) END')} AS rsi_14, {r6('line.close')} AS macd, {r6('sg.v')} AS macd_signal FROM q LEFT JOIN m20 USING (symbol, ts) LEFT JOIN line USING (symbol, ts) LEFT JOIN sg USING (symbol, ts) LEFT JOIN u USING (symbol, ts) LEFT JOIN v USING (symbol, ts)")(
    lambda s, d: final(PX.with_recursive_chunked(hour_bars(s, d), ["mma_20", "rsi_14", "macd_12_26_9", "macd_signal"], 4 * 86400).withColumnRenamed("macd_12_26_9", "macd"), "symbol", "ts", "mma_20", "rsi_14", "macd", "macd_signal")
)
query("macd", f"WITH RECURSIVE {USER}, {NUMBERED}, {_ema_sql('e12', 12, '2.0 / 13')}, {_ema_sql('e26', 26, '2.0 / 27')} SELECT q.symbol, strftime(q.ts, '{TS}') AS ts, {r6('e12.v - e26.v')} AS macd FROM q LEFT JOIN e12 USING (symbol, rn) LEFT JOIN e26 USING (symbol, rn)")(lambda s, d: final(I.with_indicators(user_bars(s, d), ["macd_12_26_9"]).withColumnRenamed("macd_12_26_9", "macd"), "symbol", "ts", "macd"))
GAINS = f"q0 AS (SELECT *, close - lag(close) OVER {ORD} AS ch FROM x), q AS (SELECT symbol, ts, greatest(ch, 0) AS up, greatest(-ch, 0) AS dn, row_number() OVER {ORD} AS rn FROM q0 WHERE ch IS NOT NULL)"
query("rsi", f"WITH RECURSIVE {USER}, {GAINS}, {_ema_sql('u', 14, '1.0 / 14', 'up')}, {_ema_sql('v', 14, '1.0 / 14', 'dn')} SELECT symbol, strftime(u.ts, '{TS}') AS ts, {r6('CASE WHEN v.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / v.v) END')} AS rsi_14 FROM u JOIN v USING (symbol, rn)")(lambda s, d: final(I.with_indicators(user_bars(s, d), ["rsi_14"]).filter("rsi_14 is not null"), "symbol", "ts", "rsi_14"))

query("mma", f"WITH RECURSIVE {HOUR}, {NUMBERED}, {_ema_sql('m9', 9, '1.0 / 9')}, {_ema_sql('m14', 14, '1.0 / 14')} SELECT q.symbol, strftime(q.ts, '{TS}') AS ts, {r6('m9.v')} AS mma_9, {r6('m14.v')} AS mma_14 FROM q LEFT JOIN m9 USING (symbol, rn) LEFT JOIN m14 USING (symbol, rn)")(lambda s, d: final(I.with_indicators(hour_bars(s, d), ["mma_9", "mma_14"]), "symbol", "ts", "mma_9", "mma_14"))
query("macd_signal", f"WITH RECURSIVE {HOUR}, {NUMBERED}, {_ema_sql('e12', 12, '2.0 / 13')}, {_ema_sql('e26', 26, '2.0 / 27')}, lq AS (SELECT symbol, e26.ts, e26.rn - 25 AS rn, e12.v - e26.v AS line FROM e26 JOIN e12 USING (symbol, rn)), {_ema_sql('sg', 9, '0.2', 'line', 'lq')} SELECT lq.symbol, strftime(lq.ts, '{TS}') AS ts, {r6('sg.v')} AS macd_signal, {r6('line - sg.v')} AS macd_hist FROM lq JOIN sg USING (symbol, rn)")(
    lambda s, d: final(I.with_indicators(hour_bars(s, d), ["macd_signal", "macd_hist"]).filter("macd_signal is not null"), "symbol", "ts", "macd_signal", "macd_hist")
)

# Own timeframes -------------------------------------------------------------------------------------------------------
FRAMES = {"5m": "s - s % 300", "10m": "s - s % 600", "15m": "s - s % 900", "2h": "s - s % 7200", "4h": "s - s % 14400", "daily": "epoch(et_date)::BIGINT"}
_COARSE = "SELECT symbol, {b} AS b, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close FROM x GROUP BY ALL"
_BY = "(PARTITION BY symbol ORDER BY b)"


def _held(values: dict[str, str]) -> str:
    """x with each timeframe's value of the interval before the bar's own. values: timeframe -> table of symbol, b, v."""
    joins = " ".join(f"LEFT JOIN (SELECT symbol, b, lag(v) OVER {_BY} AS v{t} FROM {table}) h{t} ON h{t}.symbol = x.symbol AND h{t}.b = {FRAMES[t].replace('s ', 'x.s ').replace('et_date', 'x.et_date')}" for t, table in values.items())
    return f"z AS (SELECT x.*, {', '.join(f'v{t}' for t in values)} FROM x {joins})"


metric_query("change_pct_frames", {f"change_pct_{t}": pct("close", f"v{t}") for t in ("10m", "2h", "4h")}, prelude=f"{USER}, {_held({t: f'(SELECT symbol, b, close AS v FROM ({_COARSE.format(b=FRAMES[t])}))' for t in ('10m', '2h', '4h')})}", source="z")
_FRAME_ATR = lambda t: f"(SELECT symbol, b, CASE WHEN count(*) OVER {W(14).replace('ts', 'b')} >= 14 THEN avg(tr) OVER {W(14).replace('ts', 'b')} END AS v FROM (SELECT *, greatest(high, coalesce(lag(close) OVER {_BY}, high)) - least(low, coalesce(lag(close) OVER {_BY}, low)) AS tr FROM ({_COARSE.format(b=FRAMES[t])})))"
metric_query("atr_frames", {f"atr_14_{t}": f"v{t}" for t in ("5m", "daily")}, prelude=f"{USER}, {_held({t: _FRAME_ATR(t) for t in ('5m', 'daily')})}", source="z")


def _frame_rsi(t: str) -> str:
    gains = f"q{t} AS (SELECT symbol, b AS ts, greatest(ch, 0) AS up, greatest(-ch, 0) AS dn, row_number() OVER {_BY} AS rn FROM (SELECT *, close - lag(close) OVER {_BY} AS ch FROM ({_COARSE.format(b=FRAMES[t])})) WHERE ch IS NOT NULL)"
    value = f"CASE WHEN d{t}.v = 0 THEN 100 ELSE 100 - 100 / (1 + u{t}.v / d{t}.v) END"
    # Every interval has a row, so that lag finds the one before.
    rows = f"r{t} AS (SELECT c.symbol, c.b, r.v FROM ({_COARSE.format(b=FRAMES[t])}) c LEFT JOIN (SELECT symbol, u{t}.ts AS b, {value} AS v FROM u{t} JOIN d{t} USING (symbol, rn)) r USING (symbol, b))"
    return f"{gains}, {_ema_sql(f'u{t}', 14, '1.0 / 14', 'up', f'q{t}')}, {_ema_sql(f'd{t}', 14, '1.0 / 14', 'dn', f'q{t}')}, {rows}"


metric_query("rsi_frames", {f"rsi_14_{t}": f"v{t}" for t in ("15m", "daily")}, prelude=f"RECURSIVE {USER}, {_frame_rsi('15m')}, {_frame_rsi('daily')}, {_held({t: f'r{t}' for t in ('15m', 'daily')})}", source="z")
metric_query("price_change_either", {f"price_change_{n}m_either_pct": f"coalesce({pct('close', f'lag(close, {n}) OVER {ORD}')}, CASE WHEN count(*) OVER {RANGE(n * 60)} >= 2 THEN CASE WHEN {FIRST(n * 60)} = 0 THEN 0 ELSE (close - {FIRST(n * 60)}) / {FIRST(n * 60)} * 100 END END)" for n in (1, 5, 15)})

_FRAME_SMA = lambda t, n: f"(SELECT symbol, b, CASE WHEN count(*) OVER {W(n).replace('ts', 'b')} >= {n} THEN avg(close) OVER {W(n).replace('ts', 'b')} END AS v FROM ({_COARSE.format(b=FRAMES[t])}))"
_OWN = {"ma_dist_sma10_daily_pct": pct("close", "vdaily"), "atrp_14_5m": "CASE WHEN close > 0 THEN v5m / close * 100 END", "relative_volume_15m": "v15m"}
_FRAME_RV = f"(SELECT symbol, b, CASE WHEN count(*) OVER {W(10).replace('ts', 'b')} >= 10 THEN volume / nullif(avg(volume) OVER {W(10).replace('ts', 'b')}, 0) * 100 END AS v FROM (SELECT symbol, {FRAMES['15m']} AS b, sum(volume)::BIGINT AS volume FROM x GROUP BY ALL))"
query("own_frames", sql(f"{USER}, {_held({'daily': _FRAME_SMA('daily', 10), '5m': _FRAME_ATR('5m'), '15m': _FRAME_RV})}", {c: r6(e) for c, e in _OWN.items()}, "z"))(lambda s, d: final(M.with_metrics(user_bars(s, d), list(_OWN), own_frames=True), "symbol", "ts", *_OWN))

# As-of joins and attributes -------------------------------------------------------------------------------------------
_EVENTS = "n AS (SELECT user_id::VARCHAR AS symbol, floor(epoch(ts))::BIGINT AS es FROM events WHERE event_type = 'error')"
query("news_asof", f"WITH {USER}, {_EVENTS}, j AS (SELECT x.symbol, x.ts, x.s - n.es AS age FROM x ASOF LEFT JOIN n ON x.symbol = n.symbol AND x.s >= n.es) SELECT symbol, {STAMP}, {r6('CASE WHEN age <= 86400 THEN age / 60.0 END')} AS minutes_since_news, {r6('CASE WHEN age <= 259200 THEN age / 86400.0 END')} AS days_since_news FROM j")(
    lambda s, d: final(M.with_metrics(user_bars(s, d), ["minutes_since_news", "days_since_news"], by_user(s, d).select("symbol", F.col("ts").alias("event_ts"), F.lit("news").alias("kind")).join(s.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("event_ts")), ["symbol", "event_ts"], "left_semi")), "symbol", "ts", "minutes_since_news", "days_since_news")
)
query("earnings_asof", f"WITH {USER}, {_EVENTS}, j AS (SELECT x.symbol, x.ts, n.es - x.s AS ahead FROM x ASOF LEFT JOIN n ON x.symbol = n.symbol AND x.s <= n.es) SELECT symbol, {STAMP}, {r6('ahead / 86400.0')} AS days_until_earnings FROM j")(
    lambda s, d: final(M.with_metrics(user_bars(s, d), ["days_until_earnings"], s.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("event_ts"), F.lit("earnings").alias("kind"))), "symbol", "ts", "days_until_earnings")
)
query("snapshot", f"WITH {_ticks('event_type')}, b0 AS (SELECT symbol, date_trunc('minute', ts) AS bar, {_AGG} FROM ticks WHERE ts <= '{AT}' GROUP BY ALL), z AS (SELECT * EXCLUDE (bar), bar AS ts FROM b0), m AS (SELECT *, {pct('close', f'lag(close, 5) OVER {ORD}')} AS pc5, {G(5, f'sum(volume) OVER {W(5)}')} AS v5 FROM z) SELECT symbol, {STAMP}, {r6('close')} AS price, volume AS volume_live, {r6('CASE WHEN volume > 0 THEN vwap END')} AS vwap_live, {r6('pc5')} AS price_change_5m_pct, v5::BIGINT AS volume_5m FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")(
    lambda s, d: final(M.snapshot(T.ticks_from_events(s, d, "event_type"), AT, ["price", "volume_live", "vwap_live", "price_change_5m_pct", "volume_5m"]), "symbol", "ts", "price", "volume_live", "vwap_live", "price_change_5m_pct", "volume_5m")
)
LATE = "2024-01-17 21:30:40"
#: One symbol of some hundred bars a day, up to an instant after the close.
ONE = _bars("'all'").replace("WHERE value > 0", f"WHERE value > 0 AND ts <= '{LATE}'")
_FIVE = "(PARTITION BY symbol ORDER BY et_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_DAY_METRICS = {
    "change_from_close": dif("close", "yesterday_close"), "change_from_close_postmarket": ON("postmarket", dif("close", "today_close")), "change_from_open_pct": pct("close", "today_open"), "gap_from_close": dif("today_open", "yesterday_close"),
    "range_today": f"{HI(DAY)} - {LO(DAY)}", "position_in_range_today": POS(DAY), "avg_volume_5d": "av5", "dollar_volume_daily": f"sum(CASE WHEN vwap > 0 THEN vwap ELSE close END * volume) OVER {DAY}",
    "relative_volume_same_time": f"volume / nullif(avg(volume) OVER (PARTITION BY symbol, {_MIN} ORDER BY et_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) * 100",
}
_DAY_VOLUMES = {"volume_daily": f"sum(volume) OVER {DAY}", "premarket_volume": f"sum(CASE WHEN session = 'premarket' THEN volume ELSE 0 END) OVER {DAY}", "postmarket_volume": f"sum(CASE WHEN session = 'postmarket' THEN volume ELSE 0 END) OVER {DAY}"}
query("snapshot_day", sql(f"{ONE}, {REFS}, w AS (SELECT symbol, et_date, CASE WHEN count(*) OVER {_FIVE} >= 5 THEN avg(day_volume) OVER {_FIVE} END AS av5 FROM d), v AS (SELECT y.*, av5 FROM y JOIN w USING (symbol, et_date))", {**{c: r6(e) for c, e in _DAY_METRICS.items()}, **{c: f"({e})::BIGINT" for c, e in _DAY_VOLUMES.items()}}, "v", "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"))(
    lambda s, d: final(M.snapshot(by_user(s, d).withColumn("symbol", F.lit("all")), LATE, [*_DAY_METRICS, *_DAY_VOLUMES]), "symbol", "ts", *_DAY_METRICS, *_DAY_VOLUMES)
)
query("fundamentals", f"WITH {DAYS} SELECT symbol, {STAMP}, {r6('close')} AS close, p_size::BIGINT AS attribute FROM x LEFT JOIN (SELECT p_partkey::VARCHAR AS symbol, p_size FROM part) USING (symbol)")(
    lambda s, d: final(M.with_fundamentals(day_bars(s, d), s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_size").cast("long").alias("attribute"))), "symbol", "ts", "close", "attribute")
)

# Rules and alerts -----------------------------------------------------------------------------------------------------


def _rule(i: str, *conditions: tuple, enabled: bool = True) -> dict:
    keys = ("metric", "operator", "value", "volume_threshold", "calculated_during")
    return {"id": i, "name": f"rule {i}", "enabled": enabled, "conditions": [dict(zip(keys, (*c, 0, "all")[:5] if len(c) == 3 else c, strict=False)) for c in conditions]}


RULES = [
    _rule("jump", ("price_change_5m_pct", ">", "5"), ("volume_5m", ">", "100")), _rule("range", ("range_pct_5m", ">=", "200")), _rule("drop", ("change_2m", "<", "-50")), _rule("low", ("close", "<=", "5")),
    _rule("flat", ("consecutive_candles_1m", "==", "-1")), _rule("other", ("volume", "!=", "0"), ("position_in_range_5m", ">", "95")), _rule("open", ("close", ">", "100", 0, "market")), _rule("busy", ("change_5m", ">", "0", 20000, "all")),
    _rule("early", ("close", ">", "20", 10, "premarket")), _rule("day", ("range_today", ">", "80")),
]
THRESHOLD = lambda t: f"(vd >= {t} OR pre >= {t} OR post >= {t} OR trunc(v60 * 6.5) >= {t} OR v15 * 26 >= {t} OR v5 * 78 >= {t} OR v1 * 390 >= {t})"
RULE_SQL = {
    "jump": "pc5 > 5 AND v5 > 100", "range": "rp5 >= 200", "drop": "c2 < -50", "low": "close <= 5", "flat": "abs(CASE WHEN green THEN run ELSE -run END + 1) < 1e-4", "other": "abs(volume) >= 1e-4 AND pos5 > 95",
    "open": "session = 'market' AND close > 100", "busy": f"{THRESHOLD(20000)} AND c5 > 0", "early": f"session = 'premarket' AND {THRESHOLD(10)} AND close > 20", "day": "rt > 80",
}
SCAN = f"{USER}, {RUN}, k AS (SELECT *, {pct('close', f'lag(close, 5) OVER {ORD}')} AS pc5, {VOLUMES['volume_1m']} AS v1, {VOLUMES['volume_5m']} AS v5, {VOLUMES['volume_15m']} AS v15, {VOLUMES['volume_60m']} AS v60, " + (
    f"{G(5, f'({HI(W(5))} - {LO(W(5))}) / {LO(W(5))} * 100')} AS rp5, close - lag(close, 2) OVER {ORD} AS c2, close - lag(close, 5) OVER {ORD} AS c5, {G(5, POS(W(5)))} AS pos5, {HI(DAY)} - {LO(DAY)} AS rt, sum(volume) OVER {DAY} AS vd, "
    f"sum(CASE WHEN session = 'premarket' THEN volume ELSE 0 END) OVER {DAY} AS pre, sum(CASE WHEN session = 'postmarket' THEN volume ELSE 0 END) OVER {DAY} AS post FROM c), hits AS ("
) + " UNION ALL ".join(f"SELECT symbol, ts, close AS price, '{i}' AS rule_id FROM k WHERE {e}" for i, e in RULE_SQL.items()) + ")"


def matches(spark: SparkSession, sf: str, rules: list[dict] | None = None) -> DataFrame:
    rules = rules or RULES
    return R.scan(M.with_metrics(user_bars(spark, sf), R.required_metrics(rules)), rules)


def _rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    import json

    texts = spark.createDataFrame([(json.dumps(r),) for r in rules], "json string")
    return R.parse_rules(texts, now="2024-01-01T00:00:00Z")


query("rules_scan", f"WITH {SCAN} SELECT symbol, {STAMP}, {r6('price')} AS price, rule_id FROM hits")(lambda s, d: final(matches(s, d), "symbol", "ts", "price", "rule_id"))
query("rules_scan_table_driven", f"WITH {SCAN} SELECT symbol, {STAMP}, {r6('price')} AS price, rule_id, 'rule ' || rule_id AS rule_name FROM hits")(
    lambda s, d: final(RI.scan_table(M.with_metrics(user_bars(s, d), R.required_metrics(RULES)), _rule_table(s, [*RULES, _rule("off", ("close", ">", "0"), enabled=False), _rule("bad", ("x-y", ">", "0"))])), "symbol", "ts", "price", "rule_id", "rule_name")
)


def order_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule of two or three conditions for each order, with thresholds from its price, in all operators."""
    o, i = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey")
    level = F.col("o_totalprice") % 1000 / 1000
    one = lambda metric, operator, value, threshold=0, during="all": F.struct(F.lit(metric).alias("metric"), operator.alias("operator"), value.cast("string").alias("value"), F.lit(threshold).cast("long").alias("volume_threshold"), F.lit(during).alias("calculated_during"), F.lit("").alias("timeframe"), F.lit("$").alias("value_type"))
    way = lambda *names: F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    first = one("close", way(">", ">="), 150 + F.floor(level * 100))
    second = one("volume_5m", way("<", "<=", "=="), 20 + F.floor(level * 400))
    third = F.when(i % 4 == 0, one("range_today", way(">", "!="), F.floor(level * 100), 20000)).when(i % 4 == 1, one("price_change_5m_pct", way("<", ">="), F.floor(level * 300), 0, "market"))
    return o.select(i.cast("string").alias("id"), F.concat(F.lit("order "), i).alias("name"), F.array_compact(F.array(first, second, third)).alias("conditions"), F.lit(0).cast("long").alias("cooldown"), (i % 10 != 9).alias("enabled"))


_ORDERS = """r AS (SELECT o_orderkey AS i, o_orderkey::VARCHAR AS rule_id, floor(o_totalprice % 1000 / 1000 * 100) AS l100, floor(o_totalprice % 1000 / 1000 * 300) AS l300, floor(o_totalprice % 1000 / 1000 * 400) AS l400 FROM orders WHERE o_orderkey % 10 <> 9)"""
query("rules_index", f"WITH {SCAN}, {_ORDERS} SELECT symbol, {STAMP}, {r6('close')} AS price, rule_id FROM k JOIN r ON CASE WHEN i % 2 = 0 THEN close > 150 + l100 ELSE close >= 150 + l100 END AND CASE i % 3 WHEN 0 THEN v5 < 20 + l400 WHEN 1 THEN v5 <= 20 + l400 ELSE abs(v5 - 20 - l400) < 1e-4 END AND CASE i % 4 WHEN 0 THEN rt > l100 AND {THRESHOLD(20000)} WHEN 1 THEN session = 'market' AND pc5 >= l300 ELSE true END")(
    lambda s, d: final(RI.scan_table(M.with_metrics(user_bars(s, d), RI.required(order_rules(s, d))), order_rules(s, d), metadata=False), "symbol", "ts", "price", "rule_id")
)
query("scan_counters", f"WITH {SCAN} SELECT (SELECT count(DISTINCT symbol)::BIGINT FROM k) AS symbols, (SELECT count(*)::BIGINT FROM k) AS rows, (SELECT count(*)::BIGINT * {len(RULES)} FROM k) AS rules_evaluated, (SELECT count(*)::BIGINT FROM hits) AS rules_matched")(lambda s, d: R.counters(M.with_metrics(user_bars(s, d), R.required_metrics(RULES)), RULES))
query("alert_payload", f"WITH {SCAN} SELECT sha256('jump|' || symbol || '|' || epoch_us(ts)) AS id, symbol, {STAMP}, {r6('close')} AS price, {r6('pc5')} AS change, {r6('v5')} AS volume FROM k WHERE {RULE_SQL['jump']}")(
    lambda s, d: final(A.make_alerts(matches(s, d, RULES[:1])).select("id", "symbol", "ts", F.col("price").cast("double").alias("price"), F.col("metadata")["price_change_5m_pct"].alias("change"), F.col("metadata")["volume_5m"].alias("volume")), "id", "symbol", "ts", "price", "change", "volume")
)


def event_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for each event, some with faults."""
    e, i = spark.read.parquet(f"{sf}/events.parquet"), F.col("event_id")
    metric = F.when(i % 5 == 0, "x-y").when(i % 5 == 1, "price_change_5m_pct").when(i % 5 == 2, "volume_daily").otherwise("close")
    condition = F.struct(metric.alias("metric"), F.when(i % 7 == 0, ">>").otherwise(">").alias("operator"), F.when(i % 11 == 0, "abc").otherwise(F.col("value").cast("string")).alias("value"))
    rule = F.struct(F.when(i % 13 == 0, "").otherwise(i.cast("string")).alias("id"), F.col("event_type").alias("name"), F.when(i % 17 == 0, F.array().cast("array<struct<metric: string, operator: string, value: string>>")).otherwise(F.array(condition)).alias("conditions"))
    return R.parse_rules(e.select(F.to_json(rule).alias("json")), now="2024-01-01T00:00:00Z")


_RULE_ID = "CASE WHEN event_id % 13 = 0 THEN '' ELSE event_id::VARCHAR END"
query("rules_report", f"SELECT {_RULE_ID} AS rule_id, error IS NULL AS valid, error FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'no id' WHEN event_id % 17 = 0 THEN 'no conditions' WHEN event_id % 5 = 0 THEN 'bad metric name' WHEN event_id % 7 = 0 THEN 'bad operator' WHEN event_id % 11 = 0 THEN 'value not numeric' END AS error FROM events)")(lambda s, d: R.report(event_rules(s, d)))
query("rules_enriched", f"SELECT {_RULE_ID} AS rule_id, CASE event_id % 5 WHEN 1 THEN '5m' WHEN 2 THEN 'daily' ELSE '' END AS timeframe, CASE event_id % 5 WHEN 1 THEN '%' ELSE '$' END AS value_type, CASE event_id % 5 WHEN 0 THEN 'x-y' WHEN 1 THEN 'price_change' WHEN 2 THEN 'volume' ELSE 'close' END AS base, 'all' AS during FROM events WHERE event_id % 17 <> 0")(
    lambda s, d: event_rules(s, d).select(F.col("id").alias("rule_id"), F.explode("conditions").alias("c")).select("rule_id", "c.timeframe", "c.value_type", R.base_name(F.col("c.metric")).alias("base"), F.col("c.calculated_during").alias("during"))
)
query("volume_prefilter", f"WITH {SCAN} SELECT symbol, {STAMP} FROM k WHERE {THRESHOLD(20000)}")(lambda s, d: final(M.with_metrics(user_bars(s, d), [*R.SESSION_VOLUMES, *R.SCALES]).filter(R.threshold_column(20000)), "symbol", "ts"))
query("session_prefilter", f"WITH {USER} SELECT symbol, {STAMP} FROM x WHERE session = 'postmarket'")(lambda s, d: final(M.with_metrics(user_bars(s, d), ["close"]).filter(R.session_column("postmarket")), "symbol", "ts"))
COOL = f"{SCAN}, g AS (SELECT rule_id, symbol, list_sort(list(DISTINCT floor(epoch(ts))::BIGINT)) AS l FROM hits GROUP BY ALL), kept AS (SELECT rule_id, symbol, unnest(list_reduce(l, lambda acc, t: CASE WHEN t[1] >= acc[len(acc)] + 86400 THEN list_concat(acc, t) ELSE acc END)) AS s FROM (SELECT rule_id, symbol, list_transform(l, lambda t: [t]) AS l FROM g))"
query("cooldown", f"WITH {COOL} SELECT rule_id, symbol, strftime(make_timestamp(s * 1000000), '{TS}') AS ts FROM kept")(lambda s, d: final(A.cooldown(matches(s, d), 86400), "rule_id", "symbol", "ts"))


def hot_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every bar by type above a price, five symbols in all; one has a third of the rows and more."""
    return R.scan(M.with_metrics(B.ticks_to_bars(T.ticks_from_events(spark, sf, "event_type")), ["close"]), [_rule("hot", ("close", ">", "20"))])


query("cooldown_hot", f"WITH {_bars('event_type')}, g AS (SELECT symbol, list_sort(list(DISTINCT s)) AS l FROM x WHERE close > 20 GROUP BY ALL), kept AS (SELECT symbol, unnest(list_reduce(l, lambda acc, t: CASE WHEN t[1] >= acc[len(acc)] + 7200 THEN list_concat(acc, t) ELSE acc END)) AS s FROM (SELECT symbol, list_transform(l, lambda t: [t]) AS l FROM g)) SELECT 'hot' AS rule_id, symbol, strftime(make_timestamp(s * 1000000), '{TS}') AS ts FROM kept")(lambda s, d: final(A.cooldown_parallel(hot_matches(s, d), 7200, 8), "rule_id", "symbol", "ts"))
ALERT = f"SELECT rule_id, symbol, strftime(make_timestamp(s * 1000000), '{TS}') AS ts, 'Rule ''rule ' || rule_id || ''' matched for ' || symbol AS message FROM kept"


def fired(spark: SparkSession, sf: str) -> DataFrame:
    return A.make_alerts(A.cooldown(matches(spark, sf), 86400))


query("alert_construct", f"WITH {COOL} {ALERT}")(lambda s, d: final(fired(s, d), "rule_id", "symbol", "ts", "message"))
query("alert_dedup", f"WITH {COOL} {ALERT}")(lambda s, d: final(A.dedup(fired(s, d).unionByName(fired(s, d))), "rule_id", "symbol", "ts", "message"))
query("alert_insert_ignore", f"WITH {COOL} {ALERT} WHERE rule_id <> 'low'")(lambda s, d: final(A.deliver(fired(s, d), fired(s, d).filter("rule_id = 'low'")), "rule_id", "symbol", "ts", "message"))
query("alert_history_page", f"WITH {COOL} {ALERT} WHERE rule_id = 'range' AND s >= 1704844800 ORDER BY s DESC, sha256(rule_id || '|' || symbol || '|' || s * 1000000) LIMIT 20 OFFSET 5")(lambda s, d: final(A.history(fired(s, d), rule_id="range", start="2024-01-10", limit=20, offset=5), "rule_id", "symbol", "ts", "message"))
query("subscriptions_match", f"WITH {COOL}, a AS ({ALERT}), subs AS (SELECT DISTINCT user_id::VARCHAR AS user_id, (user_id + 1)::VARCHAR AS symbol FROM events) SELECT a.*, user_id FROM a JOIN subs USING (symbol) UNION ALL SELECT a.*, 'all' FROM a")(
    lambda s, d: final(A.subscribed(fired(s, d), by_user(s, d).select(F.col("symbol").alias("user_id"), F.array((F.col("symbol").cast("long") + 1).cast("string")).alias("symbols")).distinct().unionByName(s.createDataFrame([("all", [])], "user_id string, symbols array<string>"))), "rule_id", "symbol", "ts", "message", "user_id")
)

_FOLLOWED = "subs AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'range' END AS rule_id, CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR END AS symbol FROM events WHERE user_id % 6 <> 5 AND user_id % 6 <> 1)"


def followed(spark: SparkSession, sf: str) -> DataFrame:
    """Who follows what: a rule, a symbol or both."""
    u = by_user(spark, sf).select("symbol", (F.col("symbol").cast("long") % 6).alias("k")).filter("k not in (1, 5)")
    return u.select(F.when(F.col("k") % 3 == 0, "range").alias("rule_id"), F.when(F.col("k") % 2 == 0, F.array("symbol")).otherwise(F.array().cast("array<string>")).alias("symbols"))


query("alert_user_filter", f"WITH {COOL}, a AS ({ALERT}), {_FOLLOWED} SELECT * FROM a WHERE EXISTS (SELECT 1 FROM subs u WHERE (u.rule_id IS NULL OR u.rule_id = a.rule_id) AND (u.symbol IS NULL OR u.symbol = a.symbol))")(lambda s, d: final(A.user_filter(fired(s, d), followed(s, d)), "rule_id", "symbol", "ts", "message"))

# Toplists -------------------------------------------------------------------------------------------------------------


def latest_metrics(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    bars = user_bars(spark, sf)
    df = I.with_recursive(bars, [c for c in columns if c.startswith("rsi")])
    plain = [c for c in columns if not c.startswith(("vwap_dist_signed", "rsi"))]
    df = M.with_metrics(df, list(dict.fromkeys([*plain, "volume_daily", "price_change_1m_pct", "volume_live"])))
    return B.latest_bars(df.withColumns({c: K.vwap_dist_signed(c.rsplit("_", 1)[1]) for c in columns if c.startswith("vwap_dist_signed")}), 1)


def list_values(spark: SparkSession, sf: str, specs: list[tuple]) -> DataFrame:
    columns = K.columns_of(specs)
    return K.long_values(latest_metrics(spark, sf, columns), columns)


LAST = f"{WITH_REFS}, l0 AS (SELECT *, {pct('close', f'lag(close, 5) OVER {ORD}')} AS pc5, (sum(volume) OVER {DAY})::DOUBLE AS vd, {pct('close', VW(300))} AS vs5 FROM y), l AS (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"


def _list(i: str, value: str, order: str) -> str:
    return f"SELECT '{i}' AS list_id, (row_number() OVER (ORDER BY {value} {order}, symbol))::INTEGER AS rank, symbol, {r6(value)} AS value FROM l WHERE {value} IS NOT NULL QUALIFY row_number() OVER (ORDER BY {value} {order}, symbol) <= 10"


def _lists(*ids: str):  # noqa: ANN202
    specs = [x for x in K.system_specs() if x[0] in ids]
    return lambda s, d: final(K.ranked(list_values(s, d, specs), K.spec_table(s, specs), 10), "list_id", "rank", "symbol", "value")


query("toplist_gainers", f"WITH {LAST} {_list('gainers_5m', 'pc5', 'DESC')}")(_lists("gainers_5m"))
query("toplist_losers", f"WITH {LAST} {_list('losers_5m', 'pc5', 'ASC')}")(_lists("losers_5m"))
query("toplist_several", f"WITH {LAST} " + " UNION ALL ".join(f"SELECT * FROM ({_list(*x)})" for x in (("volume_1d", "vd", "DESC"), ("vwap_dist_high", "vs5", "DESC"), ("vwap_dist_low", "vs5", "ASC"), ("gainers_5m", "pc5", "DESC"))))(_lists("volume_1d", "vwap_dist_high", "vwap_dist_low", "gainers_5m"))
_CHANGES = {"1m": "pc1", "5m": "pc5", "15m": "pc15", "1h": "pc60", "1d": "pcd"}
_VOLS = {"1m": "coalesce(v1, volume)", "5m": "v5", "15m": "v15", "1h": "v60", "1d": "vd"}
_LISTED = {**{f"gainers_{w}": (c, "DESC") for w, c in _CHANGES.items()}, **{f"losers_{w}": (c, "ASC") for w, c in _CHANGES.items()}, **{f"volume_{w}": (c, "DESC") for w, c in _VOLS.items()}, "rsi_high": ("rsi", "DESC"), "rsi_low": ("rsi", "ASC"), "relative_volume": ("rv", "DESC"), "vwap_dist_high": ("vs5", "DESC"), "vwap_dist_low": ("vs5", "ASC")}
_RSI = f"{GAINS.replace('q0 AS', 'g0 AS').replace('FROM q0', 'FROM g0').replace('), q AS', '), gq AS')}, {_ema_sql('ru', 14, '1.0 / 14', 'up', 'gq')}, {_ema_sql('rd', 14, '1.0 / 14', 'dn', 'gq')}"
ALL_LAST = f"RECURSIVE {WITH_REFS}, {_RSI}, l0 AS (SELECT y.*, {', '.join(f'{pct('close', f'lag(close, {n}) OVER {ORD}')} AS pc{n}' for n in (1, 5, 15, 60))}, {pct('close', 'yesterday_close')} AS pcd, {', '.join(f'({VOLUMES[f'volume_{n}m']})::DOUBLE AS v{n}' for n in (1, 5, 15, 60))}, (sum(volume) OVER {DAY})::DOUBLE AS vd, {G(10, f'volume / nullif(avg(volume) OVER {W(10)}, 0) * 100')} AS rv, {pct('close', VW(300))} AS vs5 FROM y), l AS (SELECT l1.*, CASE WHEN rd.v = 0 THEN 100 ELSE 100 - 100 / (1 + ru.v / rd.v) END AS rsi FROM (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) l1 LEFT JOIN ru ON ru.symbol = l1.symbol AND ru.ts = l1.ts LEFT JOIN rd ON rd.symbol = l1.symbol AND rd.ts = l1.ts)"
_all_lists = lambda s, d: list_values(s, d, K.system_specs())
query("toplist_all_specs", f"WITH {ALL_LAST} " + " UNION ALL ".join(f"SELECT * FROM ({_list(i, *x).replace('<= 10', '<= 50')})" for i, x in _LISTED.items()))(lambda s, d: final(K.ranked(_all_lists(s, d), K.spec_table(s), 50), "list_id", "rank", "symbol", "value"))
query("toplist_cardinality", f"WITH {ALL_LAST} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{i}' AS list_id, count({v})::BIGINT AS n FROM l) WHERE n > 0" for i, (v, _) in _LISTED.items()))(lambda s, d: K.cardinality(_all_lists(s, d), K.spec_table(s)))
_FILTERED = [("f", "f", "change_pct", "5m", "desc", None, True, 50.0, None, 5.0, 150.0)]
query("toplist_filtered", f"WITH {LAST}, f AS (SELECT * FROM l WHERE vd >= 50 AND close BETWEEN 5 AND 150) SELECT (row_number() OVER (ORDER BY pc5 DESC, symbol))::INTEGER AS rank, symbol, {r6('pc5')} AS value FROM f WHERE pc5 IS NOT NULL QUALIFY row_number() OVER (ORDER BY pc5 DESC, symbol) <= 10")(
    lambda s, d: final(K.ranked(list_values(s, d, _FILTERED), K.spec_table(s, _FILTERED), 10), "rank", "symbol", "value")
)
_TRADED = [("n", "n", "volume", "1d", "desc", None, True, None, None, None, None, "Brand#1", 5.0, 40.0)]


def traded_values(spark: SparkSession, sf: str) -> DataFrame:
    """Latest values of the parts as symbols, with their maker as exchange and size as market value."""
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("symbol"), F.substring("p_brand", 1, 7).alias("exchange"), F.col("p_size").cast("double").alias("market_cap"))
    last = B.latest_bars(M.with_metrics(day_bars(spark, sf), ["volume_daily", "price_change_1m_pct"]), 1)
    return K.long_values(M.with_fundamentals(last, part), K.columns_of(_TRADED), ("exchange", "market_cap"))


query("toplist_attributes", f"WITH {DAYS}, l AS (SELECT x.symbol, sum(volume) OVER {DAY}::DOUBLE AS vd, x.ts, p_brand, p_size FROM x JOIN part ON p_partkey::VARCHAR = x.symbol), m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) SELECT (row_number() OVER (ORDER BY vd DESC, symbol))::INTEGER AS rank, symbol, {r6('vd')} AS value FROM m WHERE substr(p_brand, 1, 7) = 'Brand#1' AND p_size BETWEEN 5 AND 40 QUALIFY row_number() OVER (ORDER BY vd DESC, symbol) <= 25".replace(f"sum(volume) OVER {DAY}::DOUBLE", f"(sum(volume) OVER {DAY})::DOUBLE"))(
    lambda s, d: final(K.ranked(traded_values(s, d), K.spec_table(s, _TRADED), 25), "rank", "symbol", "value")
)

# Raw messages ---------------------------------------------------------------------------------------------------------


def raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The events rendered to four JSON shapes; every 97th row is broken."""
    t = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    size, sym, iso, nanos = F.get_json_object("props", "$.k").cast("long"), F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.unix_micros("ts") * 1000
    shape = lambda **f: F.to_json(F.struct(*[c.alias(n) for n, c in f.items()]))
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit('{"T":"t","S":"'), sym, F.lit('","p":'), F.col("value").cast("string"), F.lit(',"s":'), size.cast("string"), F.lit(',"t":"'), iso, F.lit('"}')))
        .when(k == 1, shape(ev=F.lit("T"), sym=sym, p=F.col("value"), s=size, t=nanos)).when(k == 2, shape(symbol=sym, price=F.col("value"), size=size, timestamp=iso, type=F.lit("trade"))).otherwise(shape(ticker=sym, last=F.col("value"), qty=size, time=iso))
    )
    return t.select("event_id", F.when(F.col("event_id") % 97 == 0, "{broken").otherwise(text).alias("raw"))


query("normalize_messages", f"SELECT event_id, user_id::VARCHAR AS symbol, {r6('value')} AS price, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS size, {STAMP} FROM events WHERE event_id % 97 <> 0 AND value > 0")(lambda s, d: final(N.split_normalized(raw_messages(s, d))[0], "event_id", "symbol", "price", "size", "ts"))
query("normalize_errors", "SELECT CASE WHEN event_id % 97 = 0 THEN 'not JSON' ELSE 'price not positive' END AS reason, count(*)::BIGINT AS n FROM events WHERE event_id % 97 = 0 OR value <= 0 GROUP BY ALL")(lambda s, d: N.split_normalized(raw_messages(s, d))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n")))

# Patterns -------------------------------------------------------------------------------------------------------------
PRE20 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
lag = lambda c: f"lag({c}) OVER {ORD}"
PATTERNS = {
    "lower_shadow_ratio": r6("CASE WHEN abs(close - open) > 0 THEN (least(open, close) - low) / abs(close - open) END"), "upper_shadow_ratio": r6("CASE WHEN abs(close - open) > 0 THEN (high - greatest(open, close)) / abs(close - open) END"),
    "bullish_close": "close > open", "bearish_close": "close < open",
    "bullish_engulfing": f"{lag('close')} < {lag('open')} AND close > open AND open <= {lag('close')} AND close >= {lag('open')}", "bearish_engulfing": f"{lag('close')} > {lag('open')} AND close < open AND open >= {lag('close')} AND close <= {lag('open')}",
    "bullish_harami": f"{lag('close')} < {lag('open')} AND close > open AND open >= {lag('close')} AND close <= {lag('open')}", "bearish_harami": f"{lag('close')} > {lag('open')} AND close < open AND open <= {lag('close')} AND close >= {lag('open')}",
    "inside_bar": f"high < {lag('high')} AND low > {lag('low')}", "near_day_high": f"({HI(DAY)} - close) / {HI(DAY)} <= 0.01", "break_over_high": f"close > max(high) OVER {PRE20}", "break_under_low": f"close < min(low) OVER {PRE20}",
    "near_last_high": f"abs(max(high) OVER {PRE20} - close) / max(high) OVER {PRE20} <= 0.01", "reject_high": f"high >= max(high) OVER {PRE20} * (1 - 0.005) AND close <= max(high) OVER {PRE20} * (1 - 0.01)",
    "new_candle_high": f"high > {lag('high')}", "new_candle_low": f"low < {lag('low')}", "volume_spike_2": r6("volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0)"),
    "volume_spike_10": r6("volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0)"),
    "near_day_low": f"(close - {LO(DAY)}) / nullif({LO(DAY)}, 0) <= 0.01", "near_last_low": f"abs(close - min(low) OVER {PRE20}) / nullif(min(low) OVER {PRE20}, 0) <= 0.01",
    "reject_low": f"low <= min(low) OVER {PRE20} * (1 + 0.005) AND close >= min(low) OVER {PRE20} * (1 + 0.01)",
    "near_market_high": f"(max(CASE WHEN session = 'market' THEN high END) OVER {DAY} - close) / max(CASE WHEN session = 'market' THEN high END) OVER {DAY} <= 0.01",
    "near_market_low": f"(close - min(CASE WHEN session = 'market' THEN low END) OVER {DAY}) / nullif(min(CASE WHEN session = 'market' THEN low END) OVER {DAY}, 0) <= 0.01",
}
query("pattern_candles", sql(HOUR, PATTERNS))(lambda s, d: final(M.with_metrics(hour_bars(s, d), ["close"]).withColumns({k: v for k, v in P.candle_patterns().items() if k in PATTERNS}), "symbol", "ts", *PATTERNS))
query("pattern_crossings", sql(f"{HOUR}, v AS (SELECT *, {VW(3600)} AS lv FROM x)", {"cross_above": f"{lag('close')} <= {lag('lv')} AND close > lv", "cross_below": f"{lag('close')} >= {lag('lv')} AND close < lv"}, "v"))(
    lambda s, d: final(I.with_indicators(hour_bars(s, d), ["vwap_1h"]).withColumns(P.level_patterns("vwap_1h")).withColumnsRenamed({"cross_above_vwap_1h": "cross_above", "cross_below_vwap_1h": "cross_below"}), "symbol", "ts", "cross_above", "cross_below")
)
_BEF = lambda n: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
LEVELS = {
    "cross_above": "pc <= pl AND close > l", "cross_below": "pc >= pl AND close < l", "through": "abs(close - open) >= 3 * body10 AND least(open, close) < l AND greatest(open, close) > l",
    "support": "low3 <= pl * 1.002 AND close >= l * 1.005", "resistance": "high3 >= pl * 0.998 AND close <= l * 0.995", "back_to": "far3 > 0.005 AND abs(close - l) / l < 0.002",
}
query("pattern_levels", f"WITH RECURSIVE {HOUR}, {NUMBERED}, {_ema_sql('e', 20, '2.0 / 21')}, z AS (SELECT q.*, e.v AS l FROM q LEFT JOIN e USING (symbol, rn)), w AS (SELECT *, lag(close) OVER {ORD} AS pc, lag(l) OVER {ORD} AS pl, avg(abs(close - open)) OVER {_BEF(10)} AS body10, min(low) OVER {_BEF(3)} AS low3, max(high) OVER {_BEF(3)} AS high3, max(abs(close - l) / l) OVER {_BEF(3)} AS far3 FROM z) SELECT symbol, {STAMP}, {', '.join(f'{e} AS {c}_ema_20' for c, e in LEVELS.items())} FROM w")(
    lambda s, d: final(I.with_indicators(hour_bars(s, d), ["ema_20"]).withColumns(P.level_patterns("ema_20")), "symbol", "ts", *P.level_patterns("ema_20"))
)
query("pattern_running_60s", f"WITH {_ticks('event_type')}, t AS (SELECT *, floor(epoch(ts))::BIGINT AS s FROM ticks) SELECT seq, {r6('price - first_value(price) OVER (PARTITION BY symbol ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)')} AS running_60s FROM t")(lambda s, d: final(P.running_60s(T.split_valid(T.ticks_from_events(s, d, "event_type"))[0]), "seq", "running_60s"))
query("pattern_opening_range", f"WITH {HOUR}, o AS (SELECT symbol, et_date, first(high ORDER BY ts) AS rh, first(low ORDER BY ts) AS rl, min(ts) AS rt FROM x WHERE session = 'market' GROUP BY ALL) SELECT x.symbol, strftime(x.ts, '{TS}') AS ts, coalesce(x.ts > rt AND close > rh, false) AS opening_breakout, coalesce(x.ts > rt AND close < rl, false) AS opening_breakdown FROM x LEFT JOIN o USING (symbol, et_date)")(
    lambda s, d: final(P.opening_range(M.with_metrics(hour_bars(s, d), ["close"])), "symbol", "ts", "opening_breakout", "opening_breakdown")
)
