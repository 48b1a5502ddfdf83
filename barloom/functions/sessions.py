"""Market sessions and calendar expressions. Zones are named, so daylight saving is followed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"
# Minutes of the exchange's day.
PRE, OPEN, CLOSE, END = 240, 570, 960, 1200


def et(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, ZONE)


def et_date(ts: Column) -> Column:
    return F.to_date(et(ts))


def minute_of_day(ts: Column) -> Column:
    return F.hour(et(ts)) * 60 + F.minute(et(ts))


def weekend(ts: Column) -> Column:
    return F.dayofweek(et(ts)).isin(1, 7)


def market_session(ts: Column) -> Column:
    m = minute_of_day(ts)
    inside = lambda a, b: (m >= a) & (m < b)
    return F.when(weekend(ts), "closed").when(inside(PRE, OPEN), "premarket").when(inside(OPEN, CLOSE), "market").when(inside(CLOSE, END), "postmarket").otherwise("closed")


def is_open(ts: Column) -> Column:
    return market_session(ts) == "market"


def is_pre(ts: Column) -> Column:
    return market_session(ts) == "premarket"


def is_post(ts: Column) -> Column:
    return market_session(ts) == "postmarket"


def _instant(ts: Column, minute: int) -> Column:
    local = F.timestamp_seconds(F.unix_seconds(et_date(ts).cast("timestamp")) + minute * 60)
    return F.to_utc_timestamp(local, ZONE)


def market_open(ts: Column) -> Column:
    """09:30 local time of the ET date, as UTC (session time zone UTC)."""
    return _instant(ts, OPEN)


def market_close(ts: Column) -> Column:
    return _instant(ts, CLOSE)


def _since_open(ts: Column) -> Column:
    return F.floor((F.unix_seconds(ts) - F.unix_seconds(market_open(ts))) / 60).cast("long")


def minutes_since_market_open(ts: Column) -> Column:
    """0 when closed or before the open."""
    return F.when(market_session(ts) == "closed", 0).otherwise(F.greatest(_since_open(ts), F.lit(0))).cast("long")


def minutes_in_market(ts: Column) -> Column:
    """Minutes since the open on weekdays, also after hours; null up to the open."""
    return F.when(~weekend(ts) & (_since_open(ts) > 0), _since_open(ts))
