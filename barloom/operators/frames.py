"""The frames that metrics aggregate over, in two forms with one meaning.

`Frames` makes window expressions over a table of bars. `StateFrames` names columns that a stream's keyed state fills in
(`streaming.metrics`) and keeps what was asked for, so a metric's formula is written once and compiled to either form.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

C = F.col
_HOW = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "first": F.first, "count": F.count}


def _in(session: str) -> Column:
    return F.when(C("session") == session, C("volume"))


#: Columns that frames aggregate besides a bar's own.
DERIVED = {
    "dollars": lambda: F.when(C("vwap") > 0, C("vwap")).otherwise(C("close")) * C("volume"), "typical_volume": lambda: (C("high") + C("low") + C("close")) / 3 * C("volume"),
    "premarket": lambda: F.coalesce(_in("premarket"), F.lit(0)), "postmarket": lambda: F.coalesce(_in("postmarket"), F.lit(0)), "market": lambda: _in("market"),
}
#: Whole numbers, whose sums and extremes are whole too.
LONGS = {"volume", "trade_count", "premarket", "postmarket", "market"}


def column(name: str) -> Column:
    return DERIVED[name]() if name in DERIVED else C(name)


def today_rows():
    """The rows of the exchange's day up to this bar."""
    return Window.partitionBy("symbol", "et_date").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)


class Frames:
    """Window expressions, all over one order of each symbol's bars."""

    def rows(self, how: str, name: str, n: int) -> Column:
        """Over the last n bars, this one included."""
        return _HOW[how](column(name)).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0))

    def count(self, n: int) -> Column:
        """How many of the last n bars are there."""
        return F.count(F.lit(1)).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0))

    def lag(self, name: str, n: int) -> Column:
        return F.lag(column(name), n).over(Window.partitionBy("symbol").orderBy("ts"))

    def seconds(self, how: str, name: str, n: int) -> Column:
        """Over the bars of the last n seconds, both ends included; count counts bars."""
        value = F.lit(1) if how == "count" else column(name)
        return _HOW[how](value).over(Window.partitionBy("symbol").orderBy(F.unix_seconds("ts")).rangeBetween(-n, 0))

    def today(self, how: str, name: str) -> Column:
        """Over the exchange's day up to this bar."""
        return _HOW[how](column(name)).over(today_rows())

    def same_minute(self, name: str, days: int) -> Column:
        """The mean over the last so many days with a bar at this minute of the exchange's day, this one not included."""
        return F.avg(column(name)).over(Window.partitionBy("symbol", "minute_of_day").orderBy("et_date").rowsBetween(-days, -1))

    def held(self, name: str) -> Column:
        """A value that is a column of its own: daily references, candles, indicators."""
        return C(name)

    def guard(self, n: int, value: Column) -> Column:
        """value where n bars are there, else null."""
        return F.when(self.count(n) >= n, value)


class RingFrames(Frames):
    """As `Frames`, but a day's volume, dollars, high and low are those of the last n bars, whatever day they are of."""

    def __init__(self, n: int) -> None:
        self.n = n

    def today(self, how: str, name: str) -> Column:
        return self.rows(how, name, self.n) if name in ("volume", "dollars", "high", "low") else super().today(how, name)


class StateFrames(Frames):
    """Columns of the frames asked for; `asked` maps each column to its frame."""

    def __init__(self) -> None:
        self.asked: dict[str, tuple] = {}

    def _ask(self, *frame, long: bool = False) -> Column:
        name = "_f_" + "_".join(map(str, frame))
        self.asked[name] = frame
        return C(name).cast("long") if long else C(name)

    def rows(self, how: str, name: str, n: int) -> Column:
        return self._ask("rows", how, name, n, long=how != "avg" and name in LONGS)

    def count(self, n: int) -> Column:
        return self._ask("rows", "count", "close", n, long=True)

    def lag(self, name: str, n: int) -> Column:
        return self._ask("lag", name, n, long=name in LONGS)

    def seconds(self, how: str, name: str, n: int) -> Column:
        return self._ask("seconds", how, name, n, long=how == "count" or (how != "avg" and name in LONGS))

    def today(self, how: str, name: str) -> Column:
        return self._ask("today", how, name, long=how != "avg" and name in LONGS)

    def same_minute(self, name: str, days: int) -> Column:
        return self._ask("same_minute", name, days)

    def held(self, name: str) -> Column:
        return self._ask("held", name)


BATCH = Frames()
