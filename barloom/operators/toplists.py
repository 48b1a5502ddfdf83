"""Toplists: ranked symbols by metric, many lists in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.indicators import vwap_range

METRICS, WINDOWS, ORDERS = ("change_pct", "volume", "rsi", "relative_volume", "vwap_dist"), ("1m", "5m", "15m", "1h", "1d"), ("asc", "desc")
SPEC = "list_id string, name string, metric string, time_window string, sort_order string, user_id string, enabled boolean, min_volume double, min_change_pct double, price_min double, price_max double, exchange string, market_cap_min double, market_cap_max double, created_at timestamp"


#: Lists that are broadcast; more are joined by shuffle.
FEW_LISTS = 10_000
LIMITS = ("min_volume", "min_change_pct", "price_min", "price_max", "exchange", "market_cap_min", "market_cap_max")


#: The change that `min_change_pct` reads, by a list's window.
CHANGES = {"1m": "price_change_1m_pct", "5m": "price_change_5m_pct", "15m": "price_change_15m_pct", "1h": "price_change_60m_pct", "1d": "change_from_close_pct"}


def _column_of(metric: str, window: str) -> str | None:
    """The metric column that a list's metric and window mean."""
    if metric == "change_pct":
        return CHANGES.get(window)
    if metric == "volume":
        return {"1h": "volume_60m", "1d": "volume_daily"}.get(window, f"volume_{window}")
    if metric == "relative_volume":
        return {"1h": "relative_volume_60m", "1d": "relative_volume_daily"}.get(window, f"relative_volume_{window}")
    if metric == "rsi":
        return "rsi_14"
    return f"vwap_dist_signed_{window}" if window in ("5m", "15m", "1h") else None


def system_specs() -> list[tuple]:
    """The 20 seeded lists: gainers, losers and volume in each window, RSI both ways, relative volume, VWAP distance both ways."""
    rows = []
    for w in WINDOWS:
        rows += [(f"gainers_{w}", "change_pct", w, "desc"), (f"losers_{w}", "change_pct", w, "asc"), (f"volume_{w}", "volume", w, "desc")]
    rows += [("rsi_high", "rsi", "1m", "desc"), ("rsi_low", "rsi", "1m", "asc"), ("relative_volume", "relative_volume", "15m", "desc"), ("vwap_dist_high", "vwap_dist", "5m", "desc"), ("vwap_dist_low", "vwap_dist", "5m", "asc")]
    return [(i, i, m, w, o, None, True) for i, m, w, o in rows]


def spec_table(spark: SparkSession, specs: list[tuple] | None = None) -> DataFrame:
    """Specs as rows; trailing fields may be left out."""
    n = SPEC.count(",") + 1
    return spark.createDataFrame([(*s, *[None] * (n - len(s))) for s in (system_specs() if specs is None else specs)], SPEC)


def columns_of(specs: list[tuple]) -> list[str]:
    """The metric columns that specs rank by."""
    return sorted({c for _, _, m, w, *_ in specs if (c := _column_of(m, w))})


def filter_columns(specs: list[tuple]) -> list[str]:
    """The metric columns that the filters of specs read besides."""
    return sorted({"volume_daily", *(CHANGES[s[3]] for s in specs if len(s) > 8 and s[8] is not None)})


def long_values(latest: DataFrame, columns: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, metric, value, close, volume_daily, changes, extra...) of one row per symbol; changes: the change by window,
    of those among the columns; a missing 1-minute volume is the live one."""
    value = lambda c: F.coalesce(c, "volume_live") if c == "volume_1m" and "volume_live" in latest.columns else F.col(c)
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), value(c).cast("double").alias("value")) for c in columns])
    held = [x for w, c in CHANGES.items() if c in latest.columns for x in (F.lit(w), F.col(c).cast("double"))]
    changes = F.create_map(*held) if held else F.lit(None).cast("map<string,double>")
    rows = latest.select("symbol", "close", "volume_daily", changes.alias("changes"), *extra, F.explode(pairs).alias("x"))
    return rows.select("symbol", "close", "volume_daily", "changes", *extra, "x.*").filter("value is not null")


def vwap_dist_signed(window: str) -> Column:
    base = vwap_range(window)
    return F.when(base > 0, (F.col("close") - base) / base * 100)


def validate(specs: DataFrame) -> DataFrame:
    """(list_id, valid, error)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fault = (
        F.when(empty("list_id"), "no id").when(empty("name"), "no name").when(~F.coalesce(F.col("metric").isin(*METRICS), F.lit(False)), "bad metric")
        .when(~F.coalesce(F.col("time_window").isin(*WINDOWS), F.lit(False)), "bad window").when(~F.coalesce(F.col("sort_order").isin(*ORDERS), F.lit(False)), "bad order")
    )
    return specs.select("list_id", fault.isNull().alias("valid"), fault.alias("error"))


def routed(specs: DataFrame) -> DataFrame:
    """specs with the metric column each list ranks by."""
    name = F.lit(None).cast("string")
    for m in METRICS:
        for w in WINDOWS:
            if column := _column_of(m, w):
                name = F.when((F.col("metric") == m) & (F.col("time_window") == w), column).otherwise(name)
    return specs.filter("enabled").withColumn("column", name).filter("column is not null")


def _joined(long_values: DataFrame, asked: DataFrame) -> DataFrame:
    """Values with the lists that ask for their metric. Metrics are few, so a shuffle by them would send all symbols to a
    few tasks: the lists go to the values as long as they can be broadcast."""
    return long_values.join(F.broadcast(asked) if asked.limit(FEW_LISTS + 1).count() <= FEW_LISTS else asked, "metric")


def ranked(long_values: DataFrame, specs: DataFrame, n: int = 50, offset: int = 0) -> DataFrame:
    """(list_id, rank, symbol, value): one page of every list. long_values: symbol, metric, value, close, volume_daily,
    changes, and where lists ask for them exchange and market_cap.

    Filters are applied before ranking (a symbol without the value asked for does not pass); ties go by symbol.
    """
    if n < 1:
        raise ValueError("a page has one row at least")
    asked = routed(specs).select("list_id", F.col("column").alias("metric"), "time_window", "sort_order", *LIMITS)
    passes = lambda limit, ok: F.col(limit).isNull() | F.coalesce(ok, F.lit(False))
    long_values = long_values.withColumns({c: F.lit(None).cast(t) for c, t in (("exchange", "string"), ("market_cap", "double")) if c not in long_values.columns})
    rows = _joined(long_values, asked.withColumnRenamed("exchange", "only_exchange")).filter(
        passes("min_volume", F.col("volume_daily") >= F.col("min_volume")) & passes("min_change_pct", F.try_element_at("changes", F.col("time_window")) >= F.col("min_change_pct"))
        & passes("only_exchange", F.col("exchange") == F.col("only_exchange"))
        & passes("market_cap_min", F.col("market_cap") >= F.col("market_cap_min")) & passes("market_cap_max", F.col("market_cap") <= F.col("market_cap_max"))
        & passes("price_min", F.col("close") >= F.col("price_min")) & passes("price_max", F.col("close") <= F.col("price_max"))
    )
    signed = F.when(F.col("sort_order") == "asc", F.col("value")).otherwise(-F.col("value"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("list_id").orderBy(signed, "symbol")))
    return rows.filter((F.col("rank") > offset) & (F.col("rank") <= offset + n)).select("list_id", "rank", "symbol", "value")


def single(snapshot: DataFrame, column: str, ascending: bool = False, n: int = 50, offset: int = 0) -> DataFrame:
    """One list's page, as a take-ordered."""
    order = F.col(column).asc() if ascending else F.col(column).desc()
    return snapshot.filter(F.col(column).isNotNull()).orderBy(order, "symbol").offset(offset).limit(n).select("symbol", F.col(column).alias("value"))


def cardinality(long_values: DataFrame, specs: DataFrame) -> DataFrame:
    asked = routed(specs).select("list_id", F.col("column").alias("metric"))
    return _joined(long_values, asked).groupBy("list_id").agg(F.countDistinct("symbol").alias("n"))


def newest_first(specs: DataFrame) -> DataFrame:
    return specs.orderBy(F.col("created_at").desc_nulls_last(), "list_id")


def for_user(specs: DataFrame, user_id: str) -> DataFrame:
    """A user's lists, disabled ones included, newest first."""
    return newest_first(specs.filter(F.col("user_id") == user_id))


def enabled(specs: DataFrame) -> DataFrame:
    """All enabled lists, newest first."""
    return newest_first(specs.filter("enabled"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rank changes between two pages of lists: entered, left or moved."""
    b, a = before.select("list_id", "symbol", F.col("rank").alias("old_rank")), after.select("list_id", "symbol", F.col("rank").alias("new_rank"))
    both = b.join(a, ["list_id", "symbol"], "full").filter(~F.col("old_rank").eqNullSafe(F.col("new_rank")))
    return both.withColumn("kind", F.when(F.col("old_rank").isNull(), "entered").when(F.col("new_rank").isNull(), "left").otherwise("moved"))
