"""Runs of repeated word sequences, found by dyadic square catching.

Words are appended to one sequence, a batch of documents at a time, each document closed by a mark of its own, so no run
crosses documents. At every level a catcher stands on each completed block of a power of two words and watches a range of
distances behind it: at each distance it compares its block with the words that were appended there, by names that stand
for whole blocks. Blocks in a row that compare equal at one distance are a square; squares that touch at one distance merge
into one run, whose ends are then advanced word by word in halving steps. The catchers of a level advance over all blocks
of an append in one numpy step.

A run of period q and exponent e repeats (e - 1) * q words, so it holds 2 * e - 3 whole blocks in a row at the level whose
distances, 2 to 4 blocks, include q: no run is missed, and little else is followed. Names are keyed 64-bit hashes; every
run is compared word by word before it is reported, and on a false one the append is repeated under another key.

Defined results: null, empty and wordless texts have no words and no runs; equal periods are reported once, as the
smallest; rows with equal ids are rows of their own; a null id stays null; an empty table gives no rows; other columns are
ignored. Memory is some 150 bytes for each word of a batch or of the longest text, whichever is longer.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Words appended at once, unless one text has more.
APPEND = 200_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Numbers(dict):
    """Numbers words as they are first looked up."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of blocks from the names of their halves."""
    return _mixed(left * _A + (right ^ (right >> np.uint64(31))) * _B)


class Catchers:
    """The catchers over one appended sequence of numbers."""

    def __init__(self, words: np.ndarray, key: int):
        self.words = words
        self.names = [_mixed((words.astype(np.uint64) + np.uint64(key)) * _A)]

    def level(self, n: int) -> np.ndarray:
        """The names of all blocks of 2 ** n words, by start."""
        while len(self.names) <= n:
            half, size = self.names[-1], 1 << len(self.names) - 1
            self.names.append(_joined(half[: len(half) - size], half[size:]))
        return self.names[n]

    def squares(self, n: int, in_row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, distance): words of start..stop are equal to those at the distance behind; whole blocks only."""
        names, size = self.level(n), 1 << n
        nearest, beyond = (1 if n == 0 else 2 * size), 4 * size
        blocks = len(names) // size
        if blocks < in_row:
            return (np.zeros(0, np.int64),) * 3
        ahead = np.r_[names, np.zeros(beyond + size, np.uint64)]
        watched = np.lib.stride_tricks.as_strided(ahead[nearest:], (blocks, beyond - nearest), (8 * size, 8), writeable=False)
        equal = ahead[: blocks * size : size, None] == watched
        held = equal[: blocks - in_row + 1].copy()
        for i in range(1, in_row):
            held &= equal[i : blocks - in_row + 1 + i]
        opens, ends = held.copy(), held.copy()
        opens[1:] &= ~held[:-1]
        ends[:-1] &= ~held[1:]
        (first, far), (last, far_too) = np.nonzero(opens), np.nonzero(ends)
        a, b = np.lexsort((first, far)), np.lexsort((last, far_too))
        return first[a] * size, (last[b] + in_row) * size, far[a] + nearest

    def extended(self, n: int, start: np.ndarray, stop: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """start and stop moved outwards as far as the words stay equal, always by less than a block of the level."""
        for step in reversed(range(n)):
            names, size = self.level(step), 1 << step
            there = np.maximum(start - size, 0)
            start = start - size * ((start >= size) & (names[there] == names[there + distance]))
            inside = stop + distance + size <= len(self.words)
            there = np.where(inside, stop, 0)
            stop = stop + size * (inside & (names[there] == names[np.where(inside, stop + distance, 0)]))
        return start, stop

    def runs(self, exponent: int, shortest: int, longest: int) -> np.ndarray:
        """Rows (start, end, period) of the maximal runs; longest: words of the longest document."""
        found, n = [], 0
        while n == 0 or (2 << n) * exponent <= longest:
            start, stop, distance = self.squares(n, exponent - 1 if n == 0 else 2 * exponent - 3)
            start, stop = self.extended(n, start, stop, distance)
            end = stop + distance
            kept = end - start >= np.maximum(shortest, exponent * distance)
            found.append(np.stack([start, end, distance], 1)[kept])
            n += 1
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        # A multiple of a run's period shares its ends, so the smallest period of equal ends is the run's own.
        new = np.r_[True, (np.diff(rows[:, :2], axis=0) != 0).any(1)][: len(rows)]
        return rows[new]


def catch(words: np.ndarray, longest: int, exponent: int = 4, shortest: int = 6, key: int = 1) -> np.ndarray:
    """Rows (start, end, period) of the runs in a sequence of numbers, each proven word by word."""
    while True:
        rows = Catchers(words, key).runs(exponent, shortest, longest)
        if all(np.array_equal(words[s : e - q], words[s + q : e]) for s, e, q in rows.tolist()):
            return rows
        key += 1


def _append(texts: list[list[str]], exponent: int, shortest: int) -> tuple[np.ndarray, list[str]]:
    """The runs of the documents, as rows (document, start, length, period), and each document's collapsed text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    words = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    numbers = _Numbers()
    within = np.ones(len(words), bool)
    within[begins + sizes] = False
    words[within] = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    words[~within] = len(numbers) + np.arange(len(texts))
    rows = catch(words, int(sizes.max(initial=0)), exponent, shortest)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, rows[:, 0] + rows[:, 2], 1)
    np.add.at(step, rows[:, 1], -1)
    kept = np.cumsum(step[:-1]) == 0
    owner = np.searchsorted(begins, rows[:, 0], "right") - 1
    with_runs = set(owner.tolist())
    out = [" ".join(itertools.compress(t, kept[begins[i] : begins[i] + sizes[i]].tolist()) if i in with_runs else t) for i, t in enumerate(texts)]
    rows = np.stack([owner, rows[:, 0] - begins[owner], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))], out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): a document's runs of at least `exponent` periods and `shortest` words as structs
    (start, length, period), by start, then period; and its words, joined by one space, without those that any run covers
    after its first period. exponent is 2 or more."""
    if exponent < 2:
        raise ValueError("a run has an exponent of 2 at least")
    pair = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            ids, texts, parts, at = batch.column(0), [], [], 0

            def done():
                nonlocal texts, at
                rows, collapsed = _append(texts, exponent, shortest)
                bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)], fields=list(pair)))
                columns = [ids.slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()), runs, pa.array(collapsed, pa.string())]
                at, texts = at + len(texts), []
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

            size = 0
            for value in batch.column(1):
                texts.append(WORD.findall(value.as_py() or ""))
                size += len(texts[-1])
                if size > APPEND:
                    yield done()
                    size = 0
            if texts:
                yield done()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or, for one id in ten by checksum, its words with a periodic tail: from word a on, word i is word
    a + (i - a) % p. Every text that is changed has its words joined by one space."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Of `find_runs`' rows: the number of runs, the run of the greatest exponent (ties: smallest start, then period) and
    digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("key"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("*", best.alias("_best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
