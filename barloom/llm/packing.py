"""Packing token sequences by bounded-space online packing.

A document's ids (with the closing id) are cut into whole windows of `window` ids, each a sequence of its own, and a
rest. Each partition keeps `open_windows` open windows: a rest goes to the one it fits best; when it fits none, the
fullest is emitted and its place taken by a new one. The windows still open at a partition's end are merged the same way
over groups of 16 partitions, and what is left then is emitted. Memory is one document and the open windows; no id leaves
the task that made it, only the pieces' places do.

Defined results: a null or empty text is the closing id alone; equal lengths go to the earliest opened window; repeated
rows are packed as often as they come; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize
from barloom.llm.wordbpe import KEPT_WORDS, WordBpe

WINDOW = 4096
OPEN_WINDOWS = 64
END_ID = 2
MERGED = 16


class Packer:
    """A fixed number of open windows. Items are (length, thing); emitted windows are lists of things."""

    def __init__(self, window: int, open_windows: int):
        self.window, self.room, self.held = window, np.full(open_windows, window), [[] for _ in range(open_windows)]

    def place(self, length: int, thing) -> list | None:
        """Places the thing best-fit; returns the window emitted to make room, if any."""
        fits = np.where(self.room >= length, self.room, self.window + 1)
        at, emitted = int(fits.argmin()), None
        if fits[at] > self.window:
            at = int(self.room.argmin())
            emitted, self.held[at], self.room[at] = self.held[at], [], self.window
        self.held[at].append(thing)
        self.room[at] -= length
        if not self.room[at] and emitted is None:
            emitted, self.held[at], self.room[at] = self.held[at], [], self.window
        return emitted

    def rest(self) -> list[list]:
        return [h for h in self.held if h]


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left_in"]


def _pack_partition(tokenizer: str, window: int, open_windows: int):
    def run(batches):
        bpe, packer, made = WordBpe.cached(tokenizer), Packer(window, open_windows), 0
        part = TaskContext.get().partitionId()
        id_type = None

        def rows(things, left):
            nonlocal made
            offset, out = 0, []
            for doc, start, length, crc, total in things:
                out.append((doc, start, length, crc, total, part << 32 | made, offset, left))
                offset += length
            made += 1
            return out

        def table(out):
            cols = list(zip(*out, strict=True)) if out else [[]] * len(PIECE)
            kinds = [id_type or pa.int64(), *[pa.int64()] * 6, pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=PIECE)

        for batch in batches:
            id_type, out = batch.schema.field(0).type, []
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1).to_pylist()), strict=True):
                ids += END_ID.to_bytes(4, "little")
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    thing = (doc, start, len(piece) // 4, zlib.crc32(piece), total)
                    if thing[2] == window:
                        out += rows([thing], None)
                    elif emitted := packer.place(thing[2], thing):
                        out += rows(emitted, None)
            yield table(out)
        bpe.keep(KEPT_WORDS)
        yield table([r for things in packer.rest() for r in rows(things, part)])

    return run


def _merge_group(window: int, open_windows: int):
    def run(key, pdf):
        packer, done = Packer(window, open_windows), []
        for _, win in pdf.sort_values(["sequence_id", "offset"]).groupby("sequence_id", sort=True):
            if emitted := packer.place(int(win["length"].sum()), win):
                done.append(emitted)
        out = []
        for n, wins in enumerate(done + packer.rest()):
            one = pd.concat(wins)
            out.append(one.assign(sequence_id=1 << 62 | int(key[0]) << 32 | n, offset=one["length"].cumsum() - one["length"]))
        return pd.concat(out)[PIECE[:-1]]

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(rows.mapInArrow(_pack_partition(tokenizer, window, open_windows), schema + ", left_in int"), "pieces")
    left = pieces.filter("left_in is not null").groupBy((F.col("left_in") / MERGED).cast("int").alias("group"))
    merged = left.applyInPandas(_merge_group(window, open_windows), schema)
    return pieces.filter("left_in is null").drop("left_in").unionByName(merged)
