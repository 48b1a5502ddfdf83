"""Recursive indicators of one symbol over many tasks: a distributed prefix scan over chunks of time.

Each chunk of a symbol's bars is summed up by its head, the closes from which every average is surely seeded, and, for the
bars after the head, the affine map that takes each average from its value before them to its value after. A symbol's
summaries, one for each chunk of time with bars and so bounded by the calendar, are combined in order to the state before
each chunk; then the chunks are replayed from these states, each in a task of its own. No task numbers or reads a symbol's
bars as a whole.

Values are `indicators.with_recursive`'s, up to rounding: a map applies the same terms in another order.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import indicators as I

#: A week of minutes.
CHUNK_SECONDS = 7 * 86400


def warm(names: list[str]) -> int:
    """Bars after which every named indicator's averages are seeded."""
    need = {"ema": lambda n: int(n), "mma": lambda n: int(n), "rsi": lambda n: int(n) + 1, "macd": lambda n: 26 if n == "12_26_9" else 34}
    return max(need[kind](n) for kind, _, n in (name.partition("_") for name in names))


def _from_zero(x: np.ndarray, alpha: float) -> np.ndarray:
    """The average over x that begins at 0 before it."""
    return pd.Series(np.r_[0.0, x]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def tail_maps(fold: I._Fold, before: float, tail: np.ndarray) -> dict[str, list[float]]:
    """For each average of the fold: [own, kept], so that its value after the tail is own + kept * its value before; for a
    signal line also what the 12 and 26 averages before the tail add to it. before: the close before the tail."""
    out: dict[str, list[float]] = {}
    steps = np.arange(1, len(tail) + 1)
    change = np.diff(tail, prepend=before)
    for part, smooth in fold.parts.items():
        keep = 1 - smooth.alpha
        if part.startswith("macd"):
            line = _from_zero(tail, 2 / 13) - _from_zero(tail, 2 / 27)
            of = lambda x, a=smooth.alpha: float(_from_zero(x, a)[-1])
            out[part] = [of(line), keep ** len(tail), of((1 - 2 / 13) ** steps), -of((1 - 2 / 27) ** steps)]
        else:
            x = np.maximum(change, 0) if part.endswith("up") else np.maximum(-change, 0) if part.endswith("down") else tail
            out[part] = [float(_from_zero(x, smooth.alpha)[-1]), keep ** len(tail)]
    return out


def advance(fold: I._Fold, head: list[float], close: float, maps: dict[str, list[float]]) -> None:
    """Moves the fold over a chunk by its summary."""
    fold.feed(np.array(head, np.float64))
    if maps:
        before = {part: smooth.last for part, smooth in fold.parts.items()}
        for part, (own, keep, *more) in maps.items():
            fold.parts[part].last = own + keep * before[part] + (more[0] * before["ema12"] + more[1] * before["ema26"] if more else 0.0)
        fold.close = close


def _runs(*columns: list) -> list[tuple[tuple, int, int]]:
    """(key, from, to) of each run of equal keys."""
    out, at = [], 0
    for key, group in itertools.groupby(zip(*columns, strict=True)):
        n = sum(1 for _ in group)
        out.append((key, at, at + n))
        at += n
    return out


def _summaries(names: list[str]):
    """Rows symbol, chunk, close in order -> one (symbol, chunk, summary) for each chunk. A chunk is held as its closes."""
    head = warm(names)

    def one(key, pieces):
        close = np.concatenate(pieces)
        fold, tail = I._Fold(names), close[head:]
        fold.feed(close[:head])
        told = {"head": close[:head].tolist(), "close": float(close[-1]), "maps": tail_maps(fold, close[head - 1], tail) if len(tail) else {}}
        return (*key, json.dumps(told))

    def run(batches):
        now, pieces = None, []
        for batch in batches:
            out, close = [], batch.column(2).to_numpy(zero_copy_only=False)
            for key, a, b in _runs(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now and pieces:
                    out.append(one(now, pieces))
                    pieces = []
                now = key
                pieces.append(close[a:b])
            yield _table(out)
        yield _table([one(now, pieces)] if pieces else [])

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["symbol", "_chunk", "_fold"])


def _starts(names: list[str]):
    """Summaries in order -> (symbol, chunk, state before it), but for each symbol's first chunk."""

    def run(batches):
        now, fold = None, None
        for batch in batches:
            out = []
            for symbol, chunk, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold is None or symbol != now:
                    now, fold = symbol, I._Fold(names)
                else:
                    out.append((symbol, chunk, fold.state()))
                advance(fold, **json.loads(told))
            yield _table(out)

    return run


def _replayed(names: list[str], own: list[str]):
    def run(batches):
        now, fold = None, None
        for batch in batches:
            close = batch.column("close").cast(pa.float64()).to_numpy(zero_copy_only=False)
            states = batch.column("_fold").to_pylist()
            made = {n: np.full(batch.num_rows, np.nan) for n in own}
            for key, a, b in _runs(batch.column("symbol").to_pylist(), batch.column("_chunk").to_pylist()):
                if key != now:
                    now, fold = key, I._Fold(names) if states[a] is None else I._Fold.restored(names, states[a])
                    a += states[a] is not None
                if a < b:
                    for name, values in fold.feed(close[a:b]).items():
                        made[name][a:b] = values
            kept = pa.array([s is None for s in states], pa.bool_())
            columns = [batch.column(c) for c in batch.schema.names if c not in ("_chunk", "_fold")]
            arrays = [*columns, *[pa.array(x, pa.float64(), mask=np.isnan(x)) for x in made.values()]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*[c for c in batch.schema.names if c not in ("_chunk", "_fold")], *own]).filter(kept)

    return run


def with_recursive_chunked(bars: DataFrame, names: list[str], chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """bars with the named EMA, MMA, RSI and MACD columns, as `indicators.with_recursive` has them; one symbol's bars are
    spread over chunks of time. A task holds one chunk's closes. Without bars there are no rows."""
    own = [n for n in I._known_recursive(names) if n not in bars.columns]
    if not own:
        return bars
    if chunk_seconds < 1:
        raise ValueError("a chunk is a second at least")
    chunk: Column = F.floor(F.unix_seconds("ts") / chunk_seconds).cast("long")
    closes = bars.select("symbol", chunk.alias("_chunk"), F.col("close").cast("double").alias("close"), "ts").repartition("symbol", "_chunk").sortWithinPartitions("symbol", "_chunk", "ts")
    row = "symbol string, _chunk bigint, _fold string"
    summed = closes.drop("ts").mapInArrow(_summaries(own), row)
    starts = summed.repartition("symbol").sortWithinPartitions("symbol", "_chunk").mapInArrow(_starts(own), row)
    both = bars.withColumns({"_chunk": chunk, "_fold": F.lit(None).cast("string")}).unionByName(starts, allowMissingColumns=True)
    # A state has no time, so it comes before its chunk's bars.
    ordered = both.repartition("symbol", "_chunk").sortWithinPartitions("symbol", "_chunk", F.col("ts").asc_nulls_first())
    return ordered.mapInArrow(_replayed(own, own), T.StructType([*bars.schema.fields, *[T.StructField(n, T.DoubleType()) for n in own]]))
