"""Catalogue metrics over a stream of bars, from keyed state.

A metric's formula is compiled to the frames it reads (`operators.frames`); a symbol's state holds what these frames need
and no more: the last bars of the longest row or time frame, the day's running sums and extremes, one line for each of the
last days, the volumes of each minute of the day, the candles' run and the recursive indicators' few numbers. Values are
those of `metrics.with_metrics` over the same bars. A symbol's bars count in order of time; one that comes later than its
successor has already been counted is skipped, and its number told as `skipped`.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.functions import sessions as S
from barloom.operators import frames as FR
from barloom.operators import indicators as I
from barloom.operators import metrics as M
from barloom.sources.ticks import bar_fault

_MA = re.compile(r"(?:sma)_([0-9]+)")
_DAY = re.compile(r"_(avg_volume|close)_([0-9]+)d|_(high|low|biggest)_([0-9]+[dmy])")
_TODAY = {"today_open", "today_close", "yesterday_close"}


def _windows(x: np.ndarray, n: int, m: int, fill: float) -> np.ndarray:
    """The windows of n that end at each of the last m elements."""
    return np.lib.stride_tricks.sliding_window_view(np.r_[np.full(n - 1, fill), x][-(m + n - 1) :], n)


class SymbolState:
    """What the frames need of one symbol's bars so far."""

    def __init__(self, frames: dict[str, tuple]):
        self.frames = frames
        kinds = list(frames.values())
        held = [f[1] for f in kinds if f[0] == "held"]
        self.recursive = [n for n in held if I._RECURSIVE.fullmatch(n)]
        unknown = [n for n in held if not (n in self.recursive or _MA.fullmatch(n) or _DAY.fullmatch(n) or n in _TODAY or n in ("atr_14", "_candles"))]
        if unknown:
            raise ValueError(f"not metrics of a bar stream: {unknown}")
        rows = [(f[2], f[3] - 1) for f in kinds if f[0] == "rows"] + [(f[1], f[2]) for f in kinds if f[0] == "lag"]
        rows += [("close", int(found[1]) - 1) for n in held if (found := _MA.fullmatch(n))] + [("tr", 13)] * ("atr_14" in held)
        seconds = [(f[2], f[3]) for f in kinds if f[0] == "seconds"]
        self.ringed = sorted({c for c, _ in rows + seconds})
        self.deep, self.span = max([n for _, n in rows], default=0), max([n for _, n in seconds], default=0)
        self.ring = {c: np.zeros(0) for c in self.ringed}
        self.at = np.zeros(0, np.int64)
        self.us, self.count, self.skipped, self.close = None, 0, 0, None
        spans = [_DAY.fullmatch(n) for n in held]
        self.days_kept = max((int(f[2]) if f[2] else M._DAYS[f[4]] for f in spans if f), default=0)
        self.summed = sorted({f[2] for f in kinds if f[0] == "today"} | {"high", "low", "volume"})
        self.day, self.days, self.before, self.today = None, [], {}, {}
        self.opened = self.market = self.after = self.yesterday = self.close_of_day = None
        self.green, self.run = None, 0
        self.minutes: dict[int, list[float]] = {}
        self.fold = I._Fold(self.recursive) if self.recursive else None

    _KEPT = ("ring", "at", "us", "count", "skipped", "close", "day", "days", "before", "today", "opened", "market", "after", "yesterday", "green", "run", "minutes", "close_of_day")

    def dump(self) -> bytes:
        return pickle.dumps({n: getattr(self, n) for n in self._KEPT} | {"fold": self.fold and self.fold.state()})

    @classmethod
    def load(cls, frames: dict[str, tuple], state: bytes) -> SymbolState:
        made, held = cls(frames), pickle.loads(state)  # noqa: S301, written by dump
        fold = held.pop("fold")
        for name, value in held.items():
            setattr(made, name, value)
        if fold:
            made.fold = I._Fold.restored(made.recursive, fold)
        return made

    def feed(self, bars: pd.DataFrame) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
        """(the bars counted, in order; the frames' values for them)."""
        bars = bars.sort_values("in_us", kind="stable")
        new = bars if self.us is None else bars[bars["in_us"] > self.us]
        self.skipped += len(bars) - len(new)
        if not len(new):
            return new, {}
        x = {c: new[c].to_numpy(np.float64) for c in ("open", "high", "low", "close", "volume", "trade_count", *(f"in_{d}" for d in FR.DERIVED))}
        x |= {d: x.pop(f"in_{d}") for d in FR.DERIVED}
        before = np.r_[np.nan if self.close is None else self.close, x["close"][:-1]]
        x["tr"] = np.fmax(x["high"], before) - np.fmin(x["low"], before)
        out: dict[str, np.ndarray] = {}
        self._recent(x, new["in_us"].to_numpy() // 1_000_000, out)
        self._by_day(x, new["in_day"].to_numpy(), new["in_session"].tolist(), out)
        self._by_minute(x, new["in_minute"].tolist(), out)
        self._candles(x, out)
        if self.fold:
            made = self.fold.feed(x["close"])
            out |= {c: made[f[1]] for c, f in self.frames.items() if f[0] == "held" and f[1] in made}
        self.us, self.close = int(new["in_us"].iloc[-1]), float(x["close"][-1])
        return new, out

    def _recent(self, x: dict[str, np.ndarray], at: np.ndarray, out: dict[str, np.ndarray]) -> None:
        """Frames of the last rows or seconds."""
        m = len(at)
        full = {c: np.r_[self.ring[c], x[c]] for c in self.ringed}
        when = np.r_[self.at, at]
        seen = self.count + np.arange(1, m + 1)
        mean = lambda c, n: _windows(full[c], n, m, 0.0).sum(1) / np.minimum(seen, n)
        for column, (kind, *frame) in self.frames.items():
            if kind == "rows":
                how, c, n = frame
                if how == "count":
                    out[column] = np.minimum(seen, n).astype(np.float64)
                elif how == "avg":
                    out[column] = mean(c, n)
                else:
                    fill, reduced = {"sum": (0.0, np.sum), "max": (-np.inf, np.max), "min": (np.inf, np.min)}[how]
                    out[column] = reduced(_windows(full[c], n, m, fill), axis=1)
            elif kind == "lag":
                c, n = frame
                out[column] = np.r_[np.full(n, np.nan), full[c]][len(full[c]) - m : len(full[c])]
            elif kind == "seconds":
                how, c, n = frame
                end = np.arange(len(when) - m, len(when)) + 1
                begin = np.searchsorted(when, at - n, "left")
                total = np.r_[0.0, np.cumsum(full[c])]
                sums = total[end] - total[begin]
                out[column] = {"count": lambda: (end - begin).astype(np.float64), "first": lambda: full[c][begin], "sum": lambda: sums, "avg": lambda: sums / (end - begin)}[how]()
            elif kind == "held" and (found := _MA.fullmatch(frame[0])):
                out[column] = np.where(seen >= int(found[1]), mean("close", int(found[1])), np.nan)
            elif kind == "held" and frame[0] == "atr_14":
                out[column] = np.where(seen >= 14, mean("tr", 14), np.nan)
        first = min(max(len(when) - self.deep, 0), int(np.searchsorted(when, when[-1] - self.span, "left")) if self.span else len(when))
        self.ring, self.at, self.count = {c: v[first:] for c, v in full.items()}, when[first:], self.count + m

    def _new_day(self) -> None:
        """Closes the day at hand and sets out what the next one takes from the days before."""
        if self.day is not None:
            high, low, volume = self.today["high"][1], self.today["low"][2], self.today["volume"][0]
            self.days = [*self.days, (self.close_of_day, high, low, volume)][-self.days_kept :] if self.days_kept else []
            closed = self.market if self.market is not None else self.after
            self.yesterday = self.yesterday if closed is None else closed
        self.today = {c: (np.nan, np.nan, np.nan) for c in self.summed}
        self.opened = self.market = self.after = None
        n_days, self.before = len(self.days), {}
        for name in {f[1] for f in self.frames.values() if f[0] == "held"}:
            if found := _DAY.fullmatch(name):
                plain, n, extreme, span = found.groups()
                n = int(n) if n else M._DAYS[span]
                need = n - 1 if extreme in ("high", "low") else n
                last = self.days[n_days - need :] if n_days >= need else None
                value = {
                    "avg_volume": lambda d: float(np.mean([r[3] for r in d])), "close": lambda d: d[0][0], "high": lambda d: max(r[1] for r in d), "low": lambda d: min(r[2] for r in d),
                    "biggest": lambda d: max(((r[1] - r[2]) / r[2] * 100 for r in d if r[2] > 0), default=np.nan),
                }[plain or extreme]
                self.before[name] = np.nan if last is None else value(last)

    def _by_day(self, x: dict[str, np.ndarray], day: np.ndarray, session: list[str], out: dict[str, np.ndarray]) -> None:
        """Running sums and extremes of the day, references to it and to earlier days."""
        parts: dict[str, list[np.ndarray]] = {}
        for group in np.split(np.arange(len(day)), np.flatnonzero(np.diff(day)) + 1):
            a, b = group[0], group[-1] + 1
            if day[a] != self.day:
                self._new_day()
                self.day, self.opened = day[a], float(x["open"][a])
            run = {}
            for c in self.summed:
                total, most, least = self.today[c]
                v = x[c][a:b]
                there = np.cumsum(~np.isnan(v)) + (not np.isnan(total)) > 0
                sums = np.where(there, np.cumsum(np.nan_to_num(np.r_[total, v]))[1:], np.nan)
                run[c] = sums, np.fmax.accumulate(np.r_[most, v])[1:], np.fmin.accumulate(np.r_[least, v])[1:]
                self.today[c] = tuple(float(r[-1]) for r in run[c])
            closed = np.full(b - a, np.nan)
            for i in range(a, b):
                if session[i] == "market":
                    self.market = float(x["close"][i])
                elif session[i] == "postmarket" and self.after is None:
                    self.after = float(x["close"][i])
                now = self.market if self.market is not None else self.after
                closed[i - a] = np.nan if now is None else now
            self.close_of_day = float(x["close"][b - 1])
            known = {"today_open": self.opened, "yesterday_close": np.nan if self.yesterday is None else self.yesterday, **self.before}
            for column, (kind, *frame) in self.frames.items():
                if kind == "today":
                    parts.setdefault(column, []).append(run[frame[1]][("sum", "max", "min").index(frame[0])])
                elif kind == "held" and frame[0] in known:
                    parts.setdefault(column, []).append(np.full(b - a, known[frame[0]]))
                elif kind == "held" and frame[0] == "today_close":
                    parts.setdefault(column, []).append(closed)
        out |= {c: np.concatenate(p) for c, p in parts.items()}

    def _by_minute(self, x: dict[str, np.ndarray], minute: list[int], out: dict[str, np.ndarray]) -> None:
        asked = [(c, f) for c, f in self.frames.items() if f[0] == "same_minute"]
        if asked:
            (_, (_, name, days)), values = asked[0], []
            for at, v in zip(minute, x[name].tolist(), strict=True):
                held = self.minutes.setdefault(at, [])
                values.append(sum(held) / len(held) if held else np.nan)
                self.minutes[at] = [*held[1 - days :], v] if len(held) >= days else [*held, v]
            out |= dict.fromkeys((c for c, _ in asked), np.array(values))

    def _candles(self, x: dict[str, np.ndarray], out: dict[str, np.ndarray]) -> None:
        asked = [c for c, f in self.frames.items() if f == ("held", "_candles")]
        if asked:
            values = []
            for green, group in itertools.groupby((x["close"] > x["open"]).tolist()):
                n = sum(1 for _ in group)
                start = self.run if green == self.green else 0
                run = np.minimum(np.arange(start + 1, start + n + 1), 100)
                values.append(run if green else -run)
                self.green, self.run = green, int(run[-1])
            out |= dict.fromkeys(asked, np.concatenate(values).astype(np.float64))


def _inputs(bars: DataFrame) -> DataFrame:
    """The valid bars with what the state reads of each."""
    made = {"session": S.market_session(F.col("ts")), "in_us": F.unix_micros("ts"), "in_day": F.unix_date(S.et_date(F.col("ts"))), "in_minute": S.minute_of_day(F.col("ts"))}
    own = bars.filter(bar_fault().isNull()).withColumns(made).withColumns({f"in_{d}": FR.column(d).cast("double") for d in FR.DERIVED})
    return own.withColumnRenamed("session", "in_session")


class MetricState(StatefulProcessor):
    """A symbol's `SymbolState`, kept as bytes between batches."""

    def __init__(self, frames: dict[str, tuple], keep: list[str], skipped: bool):
        self.frames, self.keep, self.tell = frames, keep, skipped

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "state binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        self.held.update((bytes(initialState["state"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        bars = pd.concat(list(rows))
        if not len(bars):  # a symbol of the history alone comes with an empty frame
            return
        state = SymbolState.load(self.frames, bytes(self.held.get()[0])) if self.held.exists() else SymbolState(self.frames)
        new, made = state.feed(bars)
        self.held.update((state.dump(),))
        if len(new):
            told = {"skipped": state.skipped} if self.tell else {}
            yield pd.DataFrame({**{c: new[c].to_numpy() if new[c].dtype != object else new[c].tolist() for c in self.keep}, **made, **told})

    def close(self) -> None:
        pass


def metric_states(history: DataFrame, frames: dict[str, tuple]) -> DataFrame:
    """(symbol, state) after each symbol's bars, read in order; rows stream through, so a long history takes no memory."""

    def run(batches: Iterator[pa.RecordBatch]):
        now, state = None, None
        done = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["symbol", "state"])
        for batch in batches:
            out, frame = [], batch.to_pandas()
            for symbol, bars in frame.groupby("symbol", sort=False):
                if symbol != now:
                    if state is not None:
                        out.append((now, state.dump()))
                    now, state = symbol, SymbolState(frames)
                state.feed(bars)
            yield done(out)
        yield done([(now, state.dump())] if state is not None else [])

    return _inputs(history).repartition("symbol").sortWithinPartitions("symbol", "in_us").mapInArrow(run, "symbol string, state binary")


def stream_metrics(bars: DataFrame, names: list[str], history: DataFrame | None = None, skipped: bool = False) -> DataFrame:
    """A bar stream (symbol, ts, open, high, low, close, volume, vwap, trade_count) with the named metrics, as
    `metrics.with_metrics` adds them; any of the catalogue over a bar's own frames, and registered ones over these.

    history: bars from which each symbol's state is rebuilt before the first batch (a new query's start, or one whose
    checkpoint is lost); a restarted query goes on from its own checkpoint. skipped: adds how many bars of the symbol came
    too late so far.
    """
    own = M._in_order_of_need(names)
    plain = list(dict.fromkeys([d for n in own for d in M._custom[n][1] if d not in M._custom] + [n for n in names if n not in M._custom]))
    frames = FR.StateFrames()
    made = M.catalogue(frames)
    if unknown := [n for n in plain if n not in made]:
        raise ValueError(f"unknown metrics {unknown}")
    exprs = {n: made[n]() for n in plain if n not in bars.columns}
    asked = frames.asked
    SymbolState(asked)  # refuses what a bar stream has no state for
    tail = [T.StructField(c, T.DoubleType()) for c in asked] + [T.StructField("skipped", T.LongType())] * skipped
    first = None if history is None else metric_states(history, asked).groupBy("symbol")
    processor = MetricState(asked, bars.columns, skipped)
    df = _inputs(bars).groupBy("symbol").transformWithStateInPandas(processor, T.StructType([*bars.schema.fields, *tail]), "Append", "None", first)
    df = df.withColumns({"session": S.market_session(F.col("ts")), "et_date": S.et_date(F.col("ts"))}).withColumns(exprs)
    for n in own:
        df = df.withColumn(n, M._custom[n][0])
    return df.select(*bars.columns, "session", "et_date", *exprs, *own, *["skipped"] * skipped)
