"""Cooldown: of a rule's matches for a symbol, in order of time, the ones that fire.

The choice is greedy: the first match fires, then the first one no earlier than the cooldown after it, and so on. Of
matches at one instant one fires: the lowest in price, then by rule name and id, as far as those columns are there. A match
without a time never fires. `cooldown` folds each rule and symbol in one task. `cooldown_parallel` spreads one rule and
symbol over many tasks:

- Time is cut into chunks of `chunk` cooldowns. The last match to fire before a chunk forbids at most its first cooldown's
  length, so a chunk is entered at one of the matches there, or at the first one after: its doors. Going backwards through
  a chunk, each match learns when the next may fire after the chunk if it fires itself; only doors are kept, and of doors
  in a row with the same outcome the first and last.
- Each door points to the door of a later chunk that its outcome leads to: the first one late enough in the next chunk,
  else the first of the next chunk with matches. From the first match of all, pointers that double in length with every
  round reach all doors that are really passed, one in a chunk.
- Each chunk is folded from its door on.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.tables import cut

KEY = ["rule_id", "symbol"]


def ties(columns: list[str]) -> list[str]:
    """The columns that decide between matches of one rule and symbol at one instant."""
    return [c for c in ("price", "rule_name", "id") if c in columns]


def _fold(gap: int, by_doors: bool):
    """Lets matches through, reading rows in order: rule_id, symbol, _chunk, _at, _door. With doors, only from the door's
    time on, and not at all where none comes first."""

    def run(batches):
        now, free = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*KEY, "_chunk")), strict=True))
            keep = []
            for key, at, door in zip(keys, batch.column("_at").to_pylist(), batch.column("_door").to_pylist(), strict=True):
                if key != now:
                    now, free = key, None if by_doors else at
                if door:
                    free = at
                fires = not door and free is not None and at >= free
                keep.append(fires)
                if fires:
                    free = at + gap
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield kept.select([c for c in kept.schema.names if c not in ("_chunk", "_at", "_door")])

    return run


def _timed(matches: DataFrame, chunk: Column) -> DataFrame:
    return matches.withColumn("_at", F.unix_micros("ts")).filter("_at is not null").withColumns({"_chunk": chunk, "_door": F.lit(False)})


def cooldown(matches: DataFrame, seconds: int = 10, last: DataFrame | None = None) -> DataFrame:
    """The matches that fire. A fold over rows in order that keeps one number, so no group is held in memory. last: the
    time ts at which a rule and symbol fired before, one row for each that has."""
    keyed = _timed(matches, F.lit(0).cast("long"))
    if last is not None:
        free = (F.unix_micros("ts") + seconds * 1_000_000).alias("_at")
        keyed = keyed.unionByName(last.select(*KEY, F.lit(0).cast("long").alias("_chunk"), free, F.lit(True).alias("_door")), allowMissingColumns=True)
    ordered = keyed.repartition(*KEY).sortWithinPartitions(*KEY, F.col("_door").desc(), "_at", *ties(matches.columns))
    return ordered.mapInArrow(_fold(seconds * 1_000_000, False), matches.schema)


def _doors(gap: int, length: int):
    """Rows rule_id, symbol, _chunk, _at by falling time -> (rule_id, symbol, chunk, at, leads_to): the doors of a chunk and
    the time from which a match may fire after the chunk. Memory is the instants of one cooldown, and the doors."""

    def run(batches):
        now, waiting, after, late, seen, kept = None, deque(), None, (), None, []

        def table(out):
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*KEY, "chunk", "at", "leads_to"])

        for batch in batches:
            out = []
            for *key, at in zip(*(batch.column(c).to_pylist() for c in (*KEY, "_chunk", "_at")), strict=True):
                if key != now:
                    if now is not None:
                        out += [(*now, *door) for door in (*kept, *late)]
                    now, waiting, after, late, seen, kept = key, deque(), None, (), None, []
                if at == seen:
                    continue
                seen = at
                while waiting and waiting[0][0] >= at + gap:
                    after = waiting.popleft()[1]
                leads_to = at + gap if after is None else after
                waiting.append((at, leads_to))
                if at >= key[2] * length + gap:
                    late = ((at, leads_to),)  # so far the first after the doors' stretch
                elif len(kept) > 1 and kept[-1][1] == kept[-2][1] == leads_to:
                    kept[-1] = (at, leads_to)
                else:
                    kept.append((at, leads_to))
            yield table(out)
        out = []
        if now is not None:
            out += [(*now, *door) for door in (*kept, *late)]
        yield table(out)

    return run


def _passed(doors: DataFrame) -> DataFrame:
    """(rule_id, symbol, at, free): the doors that the greedy choice passes, by pointers that double, each with the time from
    which it is let in."""
    # One row for a rule, symbol and chunk: their number is bounded by the calendar, not by the matches.
    chunks = doors.groupBy(*KEY, "chunk").agg(F.min("at").alias("first"))
    in_order = Window.partitionBy(*KEY).orderBy("chunk")
    next_is_near = F.lead("chunk").over(in_order) == F.col("chunk") + 1
    beyond = chunks.select(*KEY, "chunk", F.when(next_is_near, F.lead("first", 2).over(in_order)).otherwise(F.lead("first").over(in_order)).alias("beyond"), (F.lag("chunk").over(in_order).isNull()).alias("begins"))
    # What leads into the next chunk goes to its first door that is late enough, found in time order within the chunk.
    asked = doors.select(*KEY, (F.col("chunk") + 1).alias("chunk"), F.col("leads_to").alias("time"), F.col("at").alias("asks"))
    both = asked.unionByName(doors.select(*KEY, "chunk", F.col("at").alias("time"), F.lit(None).cast("long").alias("asks")))
    backwards = Window.partitionBy(*KEY, "chunk").orderBy(F.col("time").desc(), F.col("asks").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("near", F.last(F.when(F.col("asks").isNull(), F.col("time")), ignorenulls=True).over(backwards)).filter("asks is not null")
    found = found.select(*KEY, (F.col("chunk") - 1).alias("chunk"), F.col("asks").alias("at"), F.col("time").alias("free"), "near")
    pointers = cut(found.join(beyond, [*KEY, "chunk"]).select(*KEY, "at", F.coalesce("near", "beyond").alias("next"), "free", "begins"))
    most = chunks.groupBy(*KEY).count().agg(F.max("count")).first()[0] or 0
    passed = cut(pointers.filter("begins").groupBy(*KEY).agg(F.min("at").alias("at")).withColumn("free", F.col("at")))
    jump = pointers.filter("next is not null").select(*KEY, "at", "next", "free")
    length = 1
    while length < most:
        passed = cut(passed.unionByName(passed.drop("free").join(jump, [*KEY, "at"]).select(*KEY, F.col("next").alias("at"), "free")))
        length *= 2
        if length < most:
            then = jump.select(*KEY, F.col("at").alias("next"), F.col("next").alias("then"), "free")
            jump = cut(jump.drop("free").join(then, [*KEY, "next"]).select(*KEY, "at", F.col("then").alias("next"), "free"))
    return passed


def cooldown_parallel(matches: DataFrame, seconds: int = 10, chunk: int = 64) -> DataFrame:
    """`cooldown`'s rows, with one rule and symbol spread over many tasks; chunk: cooldowns in a chunk of time, 2 at least.
    The doors are found at once, which runs the plan of matches; the result runs it again, so give a written table where
    that is costly."""
    if seconds < 1 or chunk < 2:
        raise ValueError("a chunk is two cooldowns at least, a cooldown one second")
    gap = seconds * 1_000_000
    length = gap * chunk
    keyed = _timed(matches, F.floor(F.unix_micros("ts") / length).cast("long"))
    backwards = keyed.select(*KEY, "_chunk", "_at").repartition(*KEY, "_chunk").sortWithinPartitions(*KEY, "_chunk", F.col("_at").desc())
    doors = cut(backwards.mapInArrow(_doors(gap, length), "rule_id string, symbol string, chunk bigint, at bigint, leads_to bigint"))
    marks = _passed(doors).select(*KEY, F.floor(F.col("at") / length).cast("long").alias("_chunk"), F.col("free").alias("_at"), F.lit(True).alias("_door"))
    both = keyed.unionByName(marks, allowMissingColumns=True)
    ordered = both.repartition(*KEY, "_chunk").sortWithinPartitions(*KEY, "_chunk", "_at", F.col("_door").desc(), *ties(matches.columns))
    return ordered.mapInArrow(_fold(gap, True), matches.schema)
