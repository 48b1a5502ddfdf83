"""Alignment of two tokenizers' ids over the same bytes, and how often each pair of ids is linked in the corpus.

The cumulative byte ends of one side are a hash set, and those of the other that it holds, in order, are where both
tokenizers end a token: they slice the two id lists into groups. Every pair of tokens whose bytes overlap is a link.

Each document's distinct pairs and their numbers are written once, as a table in the shared folder, and the corpus counts
are sums over it, combined before the shuffle. Looking the counts up again needs no shuffle for the `known` most frequent
pairs, which are broadcast (a documented bound, whatever the input); the other pairs, rare by choice, are joined by key and
summed by row. Both ways are exact.

Defined results: texts that are null, empty, or not given back byte by byte by both tokenizers have no tokens, groups or
links, and an empty digest; ties for an id's highest count all count as best; rows with equal ids are rows of their own; a
null id stays null; an empty table gives no rows; other columns are ignored. Memory is that of a batch of whole texts.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize
from barloom.llm.pieces import SPACE, PieceBpe

#: Pairs whose counts are broadcast: 17 bytes each.
KNOWN_PAIRS = 1_000_000
#: A pair is an id of the first tokenizer times this plus one of the second.
SHIFT = 1 << 20
COLUMNS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"


class BytePairs:
    """The byte-level tokenizer of a rank file: ids and bytes of a text; no text is special."""

    _one: dict[tuple[str, str], BytePairs] = {}

    @classmethod
    def cached(cls, path: str, pattern: str) -> BytePairs:
        if (path, pattern) not in cls._one:
            cls._one[path, pattern] = cls(path, pattern)
        return cls._one[path, pattern]

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.surfaces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.surfaces[rank] = token
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end: tokens of a and tokens of b up to each byte offset that ends a token on both sides."""
    held, listed = set(ends_a.tolist()), ends_b.tolist()
    stop_b = np.flatnonzero(np.fromiter(map(held.__contains__, listed), bool, len(listed))) + 1
    # Ends rise, so those of both sides are in order as they come.
    return np.searchsorted(ends_a, ends_b[stop_b - 1]) + 1, stop_b


def marked_names(size_a: int, size_b: int) -> list[str]:
    """Ids with the mark behind them: of a inside and at the end of its part of a group, then so of b; for `aligned`."""
    return [f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for i in range(size) for mark in marks]


def aligned(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, names: list[str], size_a: int) -> tuple[int, str, np.ndarray]:
    """The number of groups, the groups as text, and the pair of each link; names: `marked_names`, size_a: its first size.

    A group's tokens of a stand before its tokens of b, so a token's place is its own number and the other side's tokens of
    the groups before (for b of its group too). The bytes that two tokens share end where one of them ends: each end of a is
    a link with the token of b that holds it, and each end of b alone is one with the token of a around it."""
    stop_a, stop_b = slices(ends_a, ends_b)
    n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    text = np.empty(len(a) + len(b), np.int64)
    place_a, place_b = np.arange(len(a)) + np.repeat(stop_b - n_b, n_a), np.arange(len(b)) + np.repeat(stop_a, n_b)
    text[place_a], text[place_b] = 2 * a, 2 * (b + size_a)
    text[place_a[stop_a - 1]] += 1
    text[place_b[stop_b - 1]] += 1
    alone = np.ones(len(b), bool)
    alone[stop_b - 1] = False
    links = np.r_[a * SHIFT + b[np.searchsorted(ends_b, ends_a)], a[np.searchsorted(ends_a, ends_b[alone])] * SHIFT + b[alone]]
    return len(stop_a), "".join(map(names.__getitem__, text.tolist()))[:-1], links


def align(docs: DataFrame, ranks: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each document.

    a: the byte-level tokenizer of a rank file and split pattern, over a space and the text; b: a SentencePiece model, which
    adds the space. groups: `a1,a2|b1;a3|b2,b3`, ids in order. pairs, times: the distinct linked pairs, as a * SHIFT + b in
    rising order, and how many links hold each.
    """

    def run(batches):
        first, second = BytePairs.cached(ranks, pattern), PieceBpe.cached(model)
        names = marked_names(len(first.surfaces), len(second.surfaces))
        none = np.zeros(0, np.int64)
        size_a, size_b = (np.array([len(s) for s in t.surfaces]) for t in (first, second))

        def one(text, encoded):
            # Byte-level tokens always give the text back; pieces do, but that the mark they have for a space becomes one.
            if not text or SPACE in text:
                return 0, 0, 0, "", none
            a, b = np.array(first.encode(f" {text}"), np.int64), np.frombuffer(encoded, "<u4").astype(np.int64)
            ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
            if not ends_a[-1] == ends_b[-1] == 1 + len(text.encode()):
                raise ValueError("the tokens of a text are not of its length")
            return len(a), len(b), *aligned(a, ends_a, b, ends_b, names, len(first.surfaces))

        for batch in batches:
            n_a, n_b, n_groups, n_links, groups, pairs, times = ([] for _ in range(7))
            texts = batch.column(1).to_pylist()
            for text, encoded in zip(texts, second.encode_all(texts), strict=True):
                a, b, grouped, told, links = one(text, encoded)
                distinct, counted = np.unique(links, return_counts=True)
                for column, value in ((n_a, a), (n_b, b), (n_groups, grouped), (n_links, len(links)), (groups, told), (pairs, distinct), (times, counted.astype(np.int32))):
                    column.append(value)
            bounds = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            flat = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, kind), *lists]), kind_)) for lists, kind, kind_ in ((pairs, np.int64, pa.int64()), (times, np.int32, pa.int32()))]
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)], pa.array(groups, pa.string()), *flat]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of all rows hold each pair, and whether that is its second id's highest count."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counted = materialize(each.groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    # One row for each id of the second tokenizer: bounded by its vocabulary.
    highest = counted.groupBy((F.col("pair") % SHIFT).alias("b")).agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(highest), F.col("pair") % SHIFT == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, known: int = KNOWN_PAIRS) -> DataFrame:
    """rows of `align`, or of any table with pairs and times, without these two and with n_best, the links whose count is
    their second id's highest, and count_sum, the sum of all links' counts. rows are written once and reread."""
    spark = rows.sparkSession
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(rows), "pair-bests")
    table = counts.orderBy(F.col("n").desc(), "pair").limit(known).toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]

    def look_up(batches):
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            asked, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, asked), max(len(pair) - 1, 0))
            hit = pair[at] == asked if len(pair) else np.zeros(len(asked), bool)
            total, most = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, of[hit], times[hit] * n[at[hit]])
            np.add.at(most, of[hit], times[hit] * best[at[hit]])
            bounds = pa.array(np.r_[0, np.cumsum(np.bincount(of[~hit], minlength=batch.num_rows))].astype(np.int32))
            rare = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(asked[~hit]), pa.array(times[~hit])], names=["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(most), pa.array(total), rare], names=[*kept, "n_best", "count_sum", "_rare"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    found = rows.mapInArrow(look_up, f"{kinds}, n_best bigint, count_sum bigint, _rare array<struct<pair: bigint, times: bigint>>")
    if len(table) < known:
        return found.drop("_row", "_rare")
    rare = found.select("_row", F.explode("_rare").alias("x")).select("_row", "x.*").join(counts, "pair")
    rare = rare.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    added = found.drop("_rare").join(rare, "_row", "left")
    told = {"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}
    return added.withColumns(told).drop("_row", "_best", "_sum")


def digest(rows: DataFrame) -> DataFrame:
    """rows of `align` with a digest of the groups in place of their text; empty without tokens."""
    return rows.withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
