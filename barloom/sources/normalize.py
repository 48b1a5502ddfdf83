"""Raw provider messages (JSON strings) to ticks, as one projection over the whole dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.ticks import tick_fault

# The field names that providers use, in order of preference.
SYMBOLS = ("symbol", "sym", "S", "ticker", "instrument")
PRICES = ("price", "p", "last", "close", "ap", "bp")
SIZES = ("size", "s", "volume", "qty", "quantity")
TIMES = ("timestamp", "t", "time", "ts", "datetime")
OUT = ("symbol", "ts", "price", "size", "type", "bid", "ask")


def _f(name: str) -> Column:
    return F.col("_fields")[name]


def _number(name: str) -> Column:
    return _f(name).try_cast("double")


def _instant(name: str) -> Column:
    """An RFC 3339 string or nanoseconds since the epoch."""
    nanos = _f(name).try_cast("long")
    return F.when(nanos.isNotNull(), F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))).otherwise(F.try_to_timestamp(_f(name)))


def _positive(names) -> Column:
    return F.coalesce(*[F.when(_number(n) > 0, _number(n)) for n in names])


def normalize(messages: DataFrame, raw_col: str = "raw", provider_col: str | None = None, ingest_col: str | None = None) -> DataFrame:
    """messages' columns plus symbol, ts, price, size, type, bid, ask and `reason` (null for good ticks).

    The shape is told by provider_col (alpaca, polygon, mock, generic) or, without it, by the fields present. Where
    ingest_col is given it stands in for an unreadable timestamp; otherwise such a message is rejected. Each message is
    parsed once, to a map of its fields as text (names differ in case, so a struct would be ambiguous), and read once, to
    a tick: each is a generator's row, which the optimizer neither repeats for every use nor pulls into later filters.
    """
    own = messages.columns
    df = messages.select("*", F.explode(F.array(F.from_json(raw_col, "map<string,string>"))).alias("_fields"))
    sniffed = F.when(_f("T").isin("t", "q") & _f("S").isNotNull(), "alpaca").when(_f("ev").isin("T", "Q"), "polygon").when(_f("symbol").isNotNull() & _f("price").isNotNull() & _f("timestamp").isNotNull(), "mock").otherwise("generic")
    df = df.select("*", F.explode(F.array(F.coalesce(F.lower(F.col(provider_col)), sniffed) if provider_col else sniffed)).alias("_shape"))
    shape = F.col("_shape")
    pick = lambda a, p, m, g: F.when(shape == "alpaca", a).when(shape == "polygon", p).when(shape == "mock", m).otherwise(g)
    quote = (_f("T") == "q") | (_f("ev") == "Q")
    ask_or_bid = F.coalesce(F.when(_number("ap") > 0, _number("ap")), _number("bp"))
    price = pick(F.when(quote, ask_or_bid).otherwise(_number("p")), F.when(quote, ask_or_bid).otherwise(_number("p")), _number("price"), _positive(PRICES))
    size = pick(_number("s"), _number("s"), _number("size"), F.coalesce(*map(_number, SIZES)))
    ts = pick(_instant("t"), _instant("t"), _instant("timestamp"), F.coalesce(*map(_instant, TIMES)))
    if ingest_col:
        ts = F.coalesce(ts, F.col(ingest_col))
    tick = F.struct(
        pick(F.upper(_f("S")), _f("sym"), _f("symbol"), F.coalesce(*map(_f, SYMBOLS))).alias("symbol"), ts.alias("ts"), price.alias("price"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        F.when(quote, "quote").otherwise(F.coalesce(_f("type"), F.lit("trade"))).alias("type"), F.coalesce(_number("bp"), _number("bid")).alias("bid"), F.coalesce(_number("ap"), _number("ask")).alias("ask"),
    )
    out = df.select(*own, F.col("_fields").isNull().alias("_broken"), F.explode(F.array(tick)).alias("_tick"))
    out = out.select(*own, "_broken", *[F.col(f"_tick.{c}").alias(c) for c in OUT])
    return out.withColumn("reason", F.when(F.col("_broken"), "not JSON").otherwise(tick_fault())).drop("_broken")


def split_normalized(messages: DataFrame, **named) -> tuple[DataFrame, DataFrame]:
    told = normalize(messages, **named)
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")
