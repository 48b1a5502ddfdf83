"""Substring de-duplication by recompression.

Documents are parsed into locally consistent symbols (see recompression.py): equal windows of `window` words have the
same interior symbols, so each window picks one of them, its anchor, by content alone, and only windows with the same
anchor can be equal. One row per anchor occurrence goes to its anchor's task, with a 56-bit digest of each window that
picked it. There, among windows with equal anchor and digest, the one with the smallest (doc_id, start) is the first and
all others are repeats. Windows of anchors that are frequent in a sample go to tasks by all their words, so a hot anchor
has no task of its own; the sample decides where windows meet and never whether. Each scanning task first combines its
own windows, so a passage that a third of all documents carry sends one row per block of documents and not one per
document.

Every repeat is verified: inside a block word by word, else the first occurrence's words travel from its document to the
repeat's, where they are compared. Only compared words are removed; two different windows with one anchor and digest
(one in 7 * 10^16 pairs that share an anchor) end the job with an error instead of a wrong result. The whole texts lose the covered
words.

Defined results: a null or empty text has no words; documents shorter than a window lose nothing; overlapping repeats in
one document are judged on the input; texts of any length are taken whole (a block is at least one text); ids are keys:
rows repeated with the same id and text count as one document and get equal results; rows with a null id come before all
others, in order of a hash of their text, and ids must be above -2^62; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import recompression as rc
from barloom.llm.common import materialize

WINDOW = 20
CHUNK_BYTES = 3_000_000
DIGEST_BYTES = 7
SAMPLE_DOCS, HOT_SHARE = 5_000, 2_000
HEAD = np.dtype([("doc", "<i8"), ("start", "<i4")])


def doc_key(doc_id, raw: bytes) -> int:
    """The id, or for a null id a place before all ids that the text decides."""
    return int(doc_id) if doc_id is not None else -(1 << 62) - (xxhash.xxh3_64_intdigest(raw) >> 3)


def _chunks(batches):
    """Documents in blocks of about CHUNK_BYTES, each block ordered by key."""
    block, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            block.append((doc_key(doc_id, raw), raw))
            size += len(raw)
            if size > CHUNK_BYTES:
                yield sorted(block)
                block, size = [], 0
    if block:
        yield sorted(block)


def _first_equal(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row, the row with equal keys that comes first in `order` (a rank); itself where none comes earlier."""
    folded = keys[0]
    for k in keys[1:]:
        folded = rc.mix(folded ^ rc.mix(k))
    by = np.argsort(folded, kind="stable")
    again = np.r_[False, folded[by][1:] == folded[by][:-1]]
    near = by[again | np.r_[again[1:], False]] if len(by) else by
    out = np.arange(len(folded))
    if len(near):
        near = near[np.lexsort((order[near], *(k[near] for k in keys)))]
        same = np.ones(len(near) - 1, bool)
        for k in keys:
            same &= k[near][1:] == k[near][:-1]
        first = near[np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(near)), 0))]
        out[near] = np.where(order[near] > order[first], first, near)
    return out


def _runs(first: np.ndarray, group: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring windows in one group that repeat neighbouring windows of one group."""
    at = np.flatnonzero(first != np.arange(len(first)))
    if not len(at):
        return at, at
    origin = first[at]
    cut = (np.diff(at) > 1) | (np.diff(group[at]) != 0) | (np.diff(group[origin]) != 0) | (np.diff(start[origin]) != 1) | (np.diff(start[at]) != 1)
    return at[np.r_[True, cut]], at[np.r_[cut, True]]


def _hot_counts(window: int, n_rounds: int):
    """(anchor, n): how many different windows of each block have the anchor; the null anchor has all of them."""

    def run(batches):
        known = rc.Names()
        for block in _chunks(batches):
            names, n_tokens, _ = rc.tokens_of([r for _, r in block], known)
            docs = np.repeat(np.arange(len(block)), n_tokens)
            first, _, anchor = rc.anchors(names, docs, window, n_rounds)
            fresh = np.unique(rc.window_digests(names, first, window)[0], return_index=True)[1] if len(first) else first
            found, n = np.unique(anchor[fresh], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*found.view(np.int64).tolist(), None], pa.int64()), pa.array(np.r_[n, len(fresh)].astype(np.int64))], names=["anchor", "n"])

    return run


def hot_anchors(rows: DataFrame, window: int, n_rounds: int) -> np.ndarray:
    """At most HOT_SHARE anchors: those with at least one in HOT_SHARE of a sample's different windows."""
    sample = rows.sample(min(1.0, SAMPLE_DOCS / max(1, rows.count())), seed=1)
    counts = sample.mapInArrow(_hot_counts(window, n_rounds), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    everything = F.max(F.when(F.col("anchor").isNull(), F.col("n")))
    total = counts.agg(everything).first()[0] or 0
    least = max(2, -(-total // HOT_SHARE))
    return np.sort(np.array([r.anchor for r in counts.filter(F.col("anchor").isNotNull() & (F.col("n") >= least)).collect()], np.int64).view(np.uint64))


def _anchor_rows(window: int, n_rounds: int, hot: np.ndarray):
    """Rows (anchor, blob): blob is the document, the first window and its digests; or, for repeats found in the block
    already, an even key, the document and a word interval with no digests."""

    def run(batches):
        known = rc.Names()
        for block in _chunks(batches):
            keys = np.array([k for k, _ in block], np.int64)
            names, n_tokens, words = rc.tokens_of([r for _, r in block], known)
            docs = np.repeat(np.arange(len(block)), n_tokens)
            first, place, anchor = rc.anchors(names, docs, window, n_rounds)
            if not len(first):
                continue
            one, two = rc.window_digests(names, first, window)
            split = np.isin(anchor, hot)
            anchor = np.where(split, rc.mix(anchor ^ rc.mix(one)), anchor)
            doc = docs[first]
            origin = np.cumsum(n_tokens) - n_tokens
            start = first - origin[doc]
            same_id = np.r_[0, np.cumsum(keys[1:] != keys[:-1])]
            earlier = _first_equal((same_id[doc].astype(np.int64) << 32) + start, one, two)
            again = earlier != np.arange(len(earlier))
            a, b = _runs(earlier, doc, start)
            for d, s, e, of, at in zip(doc[a].tolist(), start[a].tolist(), start[b].tolist(), doc[earlier[a]].tolist(), start[earlier[a]].tolist(), strict=True):
                _verify(words[d][s : e + window], words[of][at : at + e - s + window])
            del words
            local = [_blob(k, s, b"") + int(e).to_bytes(4, "little") for k, s, e in zip(keys[doc[a]].tolist(), start[a].tolist(), (start[b] + window).tolist(), strict=True)]
            spread = rc.mix(keys[doc[a]].astype(np.uint64))
            cut = np.flatnonzero((np.diff(place) != 0) | (anchor[1:] != anchor[:-1]) | (np.diff(doc) != 0) | (np.diff(first) > 1) | (again[1:] != again[:-1])) + 1
            heads = np.r_[0, cut]
            tails = np.r_[cut, len(first)]
            fresh = ~again[heads]
            heads, tails = heads[fresh], tails[fresh]
            digests = np.ascontiguousarray(two.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :DIGEST_BYTES]).tobytes()
            blobs = [_blob(k, s, digests[DIGEST_BYTES * i : DIGEST_BYTES * j]) for k, s, i, j in zip(keys[doc[heads]].tolist(), start[heads].tolist(), heads.tolist(), tails.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[anchor[heads], spread].view(np.int64)), pa.array(blobs + local, pa.binary()), pa.array(np.r_[np.ones(len(heads), bool), np.zeros(len(a), bool)]),
            ], names=["anchor", "blob", "fresh"])

    return run


def _verify(words: list[bytes], origin: list[bytes]) -> None:
    if words != origin:
        raise ValueError(f"two different windows share anchor and digest; choose another recompression.KEY: {words!r} {origin!r}"[:2000])


def _blob(doc: int, start: int, digests: bytes) -> bytes:
    return doc.to_bytes(8, "little", signed=True) + start.to_bytes(4, "little") + digests


def _interval_rows(window: int):
    """From rows sorted by anchor: (doc, begin, end, origin, at), the word intervals that repeats cover, and where they
    stand first; without origin if that was verified already."""

    def judged(anchor, blobs):
        sizes = (np.fromiter(map(len, blobs), np.int64, len(blobs)) - HEAD.itemsize) // DIGEST_BYTES
        heads = np.frombuffer(b"".join([x[: HEAD.itemsize] for x in blobs]), HEAD)
        flat = np.frombuffer(b"".join([x[HEAD.itemsize :] for x in blobs]), np.uint8).reshape(-1, DIGEST_BYTES)
        wide = np.zeros((len(flat), 8), np.uint8)
        wide[:, :DIGEST_BYTES] = flat
        digests = wide.view("<u8").ravel()
        row = np.repeat(np.arange(len(blobs)), sizes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = heads["start"][row] + nth
        ids, rank = np.unique(heads["doc"], return_inverse=True)
        first = _first_equal((rank[row].astype(np.int64) << 32) + start, anchor[row], digests)
        a, b = _runs(first, row, start)
        return heads["doc"][row[a]], start[a], start[b] + window, heads["doc"][row[first[a]]], start[first[a]]

    def run(batches):
        held, size = [], 0

        def made(cols):
            none = pa.nulls(len(cols[0]), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(c, np.int64)) for c in cols), *[none] * (5 - len(cols))], names=["doc", "begin", "end", "origin", "at"])

        for batch in batches:
            anchor, fresh = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            blobs = batch.column(1).to_pylist()
            known = [x for x, f in zip(blobs, fresh, strict=True) if not f]
            if known:
                told = np.frombuffer(b"".join(known), np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")]))
                yield made((told["doc"], told["start"], told["end"]))
            held.append((anchor[fresh], [x for x, f in zip(blobs, fresh, strict=True) if f]))
            size += len(held[-1][1])
            if size >= 200_000:
                anchor, blobs = np.concatenate([h[0] for h in held]), [x for h in held for x in h[1]]
                cut = int(np.searchsorted(anchor.view(np.int64), anchor.view(np.int64)[-1], "left"))
                if cut:
                    yield made(judged(anchor[:cut], blobs[:cut]))
                held, size = [(anchor[cut:], blobs[cut:])], 0
        if held:
            anchor, blobs = np.concatenate([h[0] for h in held]), [x for h in held for x in h[1]]
            if blobs:
                yield made(judged(anchor, blobs))

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, n_rounds: int = rc.ROUNDS) -> DataFrame:
    """Word intervals [begin, end) of the document with key `doc` that windows seen earlier cover, with the document and
    word where those stand (null: compared already); intervals may overlap. The caller compares the words."""
    if window < 4:
        raise ValueError("window must be 4 words or more")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    named = rows.mapInArrow(_anchor_rows(window, n_rounds, hot_anchors(rows, window, n_rounds)), "anchor bigint, blob binary, fresh boolean")
    return named.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_interval_rows(window), "doc bigint, begin bigint, end bigint, origin bigint, at bigint")


def _pressed(batches):
    """(doc, id, text compressed): what travels of a document."""
    press = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        keys, out = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            keys.append(doc_key(doc_id, raw))
            out.append(press.compress(raw))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), pa.array(out, pa.binary())], names=["doc", "_id", "pressed"])


def _origin_rows(batches):
    """(doc, begin, end, span): the words that should stand at doc's interval, from the document where they stand first.
    Overlapping intervals at one distance are one."""
    open_, last, words = zstandard.ZstdDecompressor(), None, []
    for batch in batches:
        batch = batch.filter(batch.column("asks").is_valid())
        out = []
        for pressed, doc, asks in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if pressed != last:
                last, words = pressed, open_.decompress(pressed).split()
            far = begin = end = None
            for away, b, e in [*sorted((x["at"] - x["begin"], x["begin"], x["end"]) for x in asks), (None, 0, 0)]:
                if away == far and b <= end:
                    end = max(end, e)
                    continue
                if far is not None:
                    out.append((doc, begin, end, b" ".join(words[begin + far : end + far])))
                far, begin, end = away, b, e
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc", "begin", "end", "span"])


def _without(raw: bytes, covers: list[dict]) -> tuple[list[bytes], int]:
    """The words that no interval covers, and how many words there were."""
    words = raw.split()
    if not covers:
        return words, len(words)
    change = np.zeros(len(words) + 1, np.int64)
    for c in covers:
        if c["span"] is not None:
            _verify(words[c["begin"] : c["end"]], c["span"].split(b" "))
        change[c["begin"]] += 1
        change[c["end"]] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k], len(words)


def _kept_rows(as_text: bool):
    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for pressed, covers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, n = _without(open_.decompress(pressed), covers or [])
                kept = b" ".join(words)
                rows.append((n, n - len(words), kept.decode("utf-8", "surrogatepass") if as_text else hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["_id", "n_words", "n_removed", "kept"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, as_text: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_removed, and `kept`, the rest's text (or its SHA-256)."""
    found = materialize(repeats(docs, id_col, text_col, window), "repeats")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    texts = rows.mapInArrow(_pressed, "doc bigint, _id bigint, pressed binary")
    asked = found.filter("origin is not null").groupBy("origin", F.col("doc").alias("of")).agg(F.collect_list(F.struct("begin", "end", "at")).alias("asks"))
    # A left join of all columns, as below, so that both joins take the texts from one exchange.
    spans = texts.join(asked, F.col("doc") == F.col("origin"), "left").select("_id", "pressed", "of", "asks").mapInArrow(_origin_rows, "doc bigint, begin bigint, end bigint, span binary")
    covered = found.filter("origin is null").select("doc", "begin", "end", F.lit(None).cast("binary").alias("span")).unionByName(spans)
    covered = covered.groupBy("doc").agg(F.collect_list(F.struct("begin", "end", "span")).alias("covers"))
    out = texts.join(covered, "doc", "left").select("_id", "pressed", "covers").mapInArrow(_kept_rows(as_text), "_id bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept")
