"""N-gram Jaccard join with set-relation skipping, to connected components.

Candidates. A document's set of k-word shingles, in hash order, is cut by hash range into m parts. Two sets of sizes in
one band that reach the threshold differ in at most D elements, so of m = D + 1 + r parts at least r + 1 are the same in
both. Each set leaves out its r weakest parts: those with the fewest shingles that are not common (a list from a bounded
sample), then the fewest shingles, then the lowest key. The strongest part that two such sets share has r weaker ones
beside it in either set, so both keep it and no link is missed, whatever the list of common shingles; but phrases that
many documents carry seldom tie them. Each kept part is a posting; documents that share a posting are tied to the
smallest one that they are connected with (never pair by pair), first inside each scanning block, then in each stretch of
keys, and the ties' components hold every link. Postings travel by stretches of their keys, packed, and cut to KEY_BYTES beyond the stretch: two keys that meet by
the cut are a tie too many, and links are counted on the sets.

Links. The sets of a component are grouped by size bands, of which only neighbours can be linked, and joined band by band
in blocks of at most `block` sets: a band of one block in one task, larger ones in block pairs (at most 32 blocks until
blocks reach 20,000 sets or 1,000,000 shingles, whichever comes first). Inside, inverted lists are ordered by set size, so
the parts of a list whose sizes cannot reach the threshold are skipped by position; and a set's overlap counts are derived
from those of the most similar set just computed, by the lists of the elements in which the two differ. Only links that
join two parts not yet connected are emitted: at most one per set and block pair.

Defined results: a null or empty text has an empty set and is linked with nothing; fewer than k words make one shingle of
the whole sequence; texts of any length are taken whole; ids must be below 2^62; rows repeated with the same id and text are one document and get equal results; rows with a null id
are linked but never name a component (component_id is null where no id is reachable); an empty table gives an empty
table; other columns are ignored by `join` and passed through by `one_of_each`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import recompression as rc
from barloom.llm.common import materialize, small
from barloom.llm.graph import components

SHINGLE = 4
PERCENT = 85
CHUNK_BYTES = 3_000_000
BLOCK, MOST_BLOCKS, LARGEST_BLOCK = 192, 32, 20_000
LARGEST_SHINGLES = 1_000_000
#: Stretches of posting keys, and the bytes of a key that follow.
SLOT_BITS, KEY_BYTES = 12, 5
#: Ties that a task holds before it passes them on.
MOST_TIES = 200_000
#: Shingles are common that stand in at least LEAST_COMMON of about SAMPLE_DOCS texts; MOST_COMMON of them are told.
SAMPLE_DOCS, LEAST_COMMON, MOST_COMMON = 10_000, 3, 500_000
NO_ID = 1 << 62


def doc_key(doc_id, raw: bytes) -> int:
    """The id, or for a null id a number above all ids that the text decides."""
    return int(doc_id) if doc_id is not None else NO_ID + (xxhash.xxh3_64_intdigest(raw) >> 3)


def shingle_sets(raws: list[bytes], k: int = SHINGLE, known: rc.Names | None = None) -> list[np.ndarray]:
    """The sorted 64-bit shingle names of each lower-cased text."""
    names, counts, _ = rc.tokens_of([r.lower() for r in raws], rc.Names() if known is None else known)
    bounds = [0, *np.cumsum(counts).tolist()]
    whole = names
    for step in range(1, k):
        whole = rc.mix(whole[: len(names) - step] * np.uint64(2 * step + 1) + names[step:]) if len(names) > step else names[:0]
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for name in names[a:b]:
                h = rc.mix(h * np.uint64(11) + name)
            out.append(h)
        else:
            out.append(names[:0])
    return out


class Parts:
    """The cut of sets into parts, by size band: (parts, how many of them are kept)."""

    def __init__(self, percent: int):
        self.percent, self.least, self.plans = percent, [1], []
        while self.least[-1] < 1 << 40:
            self.least.append(self.least[-1] * 100 // percent + 1)
        for k in range(len(self.least) - 1):
            most = 2 * (self.least[k + 1] - 1)
            differ = max(s - 2 * -(-percent * s // (100 + percent)) for s in range(max(1, most - 100), most + 1))
            self.plans.append((differ + 1 + (2 + differ // 4 if differ else 0), differ + 1))
        self.least = np.array(self.least)

    def keys(self, names: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """The postings of a set: its strongest parts as a member of its own size band and of the next. common: which
        shingles are."""
        band = int(np.searchsorted(self.least, len(names), "right")) - 1
        high, sums = names >> np.uint64(32), np.r_[np.uint64(0), np.cumsum(rc.mix(names))]
        rare = np.arange(len(names) + 1) if common is None else np.r_[0, np.cumsum(~common)]
        out = []
        for k in (band, band + 1):
            m, kept = self.plans[k]
            edges = np.searchsorted((high * np.uint64(m)) >> np.uint64(32), np.arange(m + 1, dtype=np.uint64))
            key = rc.mix(sums[edges[1:]] - sums[edges[:-1]] + _steps(m) + np.uint64(k * 0x9E3779B1))
            strength = (np.diff(rare[edges]) << 32) + np.diff(edges)
            out.append(key[np.lexsort((key, strength))[m - kept :]])
        return np.concatenate(out)


def _steps(m: int) -> np.ndarray:
    return rc.mix(np.arange(1, m + 1, dtype=np.uint64))


def _chunks(batches):
    block, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            block.append((doc_key(doc_id, raw), raw, doc_id))
            size += len(raw)
            if size > CHUNK_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block


def _counted(k: int):
    """(shingle, n): in how many of a block's different sets each shingle stands."""

    def run(batches):
        known = rc.Names()
        for block in _chunks(batches):
            sets = {s.tobytes(): s for s in shingle_sets([r for _, r, _ in block], k, known)}
            found, n = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return run


def common_shingles(rows: DataFrame, k: int) -> np.ndarray:
    """Sorted names of at most MOST_COMMON shingles, the most frequent ones of a sample."""
    sample = rows.sample(min(1.0, SAMPLE_DOCS / max(1, rows.count())), seed=1)
    counts = sample.mapInArrow(_counted(k), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    told = counts.filter(F.col("n") >= LEAST_COMMON).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).select("shingle").toArrow()
    return np.sort(told.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _among(names: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which names stand in a sorted list."""
    if not len(listed):
        return np.zeros(len(names), bool)
    return listed[np.minimum(np.searchsorted(listed, names), len(listed) - 1)] == names


FOUND = "slot bigint, base bigint, width int, packed binary, a bigint, b bigint, _id bigint, n_shingles bigint, mark bigint"


def _set_rows(k: int, percent: int, common):
    """Rows FOUND, of three kinds. Postings of a block with keys in one slot, packed (see `_packed`). A tie of documents a
    and b found inside the block. Document a with its id and size, and as b and mark the digest of its set (of an empty
    one, its key). Of equal sets in a block only the smallest document posts. common: a broadcast list."""

    def run(batches):
        parts, known = Parts(percent), rc.Names()
        for block in _chunks(batches):
            sets = shingle_sets([r for _, r, _ in block], k, known)
            marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else d.to_bytes(16, "little") for (d, _, _), s in zip(block, sets, strict=True)]
            first: dict[bytes, tuple[int, np.ndarray]] = {}
            for mark, (key, _, _), s in zip(marks, block, sets, strict=True):
                first[mark] = (min(key, first[mark][0]) if mark in first else key, s)
            halves = np.frombuffer(b"".join(marks), np.int64)
            ids = np.array([d for d, _, _ in block], np.int64)
            yield _found(
                len(block), slot=rc.mix(ids.view(np.uint64)).view(np.int64), a=ids, b=np.ascontiguousarray(halves[::2]),
                _id=pa.array([i for _, _, i in block], pa.int64()), n_shingles=np.array([len(s) for s in sets], np.int64), mark=np.ascontiguousarray(halves[1::2]),
            )
            posted = [(d, s) for d, s in first.values() if len(s)]
            if not posted:
                continue
            ends = np.cumsum([len(s) for _, s in posted])
            usual = np.split(_among(np.concatenate([s for _, s in posted]), common.value), ends[:-1])
            made = [parts.keys(s, u) for (_, s), u in zip(posted, usual, strict=True)]
            keys, docs = np.concatenate(made), np.repeat(np.array([d for d, _ in posted], np.int64), [len(m) for m in made])
            keys, docs, ties = _tied(keys, docs)
            yield _packed(keys, docs)
            yield _found(len(ties), slot=rc.mix(ties[:, 0].astype(np.uint64) ^ rc.mix(ties[:, 1].astype(np.uint64))).view(np.int64), a=np.ascontiguousarray(ties[:, 0]), b=np.ascontiguousarray(ties[:, 1]))

    return run


def _tied(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, ascending, with the document that stands for its own, and the ties (see `_forest`) that the lists make."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order
    hub = np.repeat(docs[heads], np.diff(np.r_[heads, len(keys)]))
    ties = _forest(hub[hub != docs], docs[hub != docs])
    keys, docs = keys[heads], docs[heads]
    at = np.minimum(np.searchsorted(ties[:, 1], docs), max(len(ties) - 1, 0))
    return keys, np.where(ties[at, 1] == docs, ties[at, 0], docs) if len(ties) else docs, ties


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ties that connect what those of a and b do, in order of their second document: each with the smallest one that it
    is connected with, so that a document has one tie at most, however many lists it shares with others."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    label, u, v = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        low, least = label.copy(), np.minimum(label[u], label[v])
        for which in (u, v, label[u], label[v]):
            np.minimum.at(low, which, least)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(label)))
    return np.stack([nodes[label[moved]], nodes[moved]], 1)


def _found(n: int, **given) -> pa.RecordBatch:
    fields = [(f.split()[0], {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in fields], names=[c for c, _ in fields])


def _packed(keys: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """Postings with ascending keys, a row for each slot: KEY_BYTES of each key after the slot's bits, and its document
    less the least one of the block in as few bytes as the block's documents need."""
    slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    base = docs.min()
    beyond = docs.view(np.uint64) - np.array([base]).view(np.uint64)
    width = max(1, -(-int(beyond.max()).bit_length() // 8))
    cells = np.empty((len(keys), KEY_BYTES + width), np.uint8)
    cells[:, :KEY_BYTES] = _bytes(keys >> np.uint64(64 - SLOT_BITS - 8 * KEY_BYTES))[:, :KEY_BYTES]
    cells[:, KEY_BYTES:] = _bytes(beyond)[:, :width]
    heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    ends = np.r_[heads, len(keys)] * (KEY_BYTES + width)
    packed = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cells)])
    return _found(len(heads), slot=slot[heads], base=np.full(len(heads), base), width=np.full(len(heads), width, np.int32), packed=packed)


def _bytes(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of packed rows; a key is the slot's bits and the KEY_BYTES that follow."""
    keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    slots, bases, widths = (batch.column(c).to_numpy() for c in ("slot", "base", "width"))
    for width in np.unique(widths).tolist():
        which = widths == width
        rows = batch.column("packed").filter(pa.array(which)).to_pylist()
        n = np.fromiter(map(len, rows), np.int64, len(rows)) // (KEY_BYTES + width)
        cells = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, KEY_BYTES + width)
        both = np.zeros((2, len(cells), 8), np.uint8)
        both[0, :, :KEY_BYTES], both[1, :, :width] = cells[:, :KEY_BYTES], cells[:, KEY_BYTES:]
        low, beyond = both.view("<u8")[..., 0]
        keys.append((np.repeat(slots[which], n).view(np.uint64) << np.uint64(8 * KEY_BYTES)) | low)
        docs.append((np.repeat(bases[which], n).view(np.uint64) + beyond).view(np.int64))
    return np.concatenate(keys), np.concatenate(docs)


def _tie_rows(batches):
    """From rows sorted by slot: ties and documents as they came, and the ties that a slot's posting lists make.
    A slot's postings are held until the next slot, and ties until they are MOST_TIES or the last ones."""
    held, now, made = [], None, [np.zeros((0, 2), np.int64)]

    def tie():
        made.append(_tied(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))[2])

    def told():
        ties = _forest(*np.concatenate(made).T)
        made[1:] = []
        return _found(len(ties), a=np.ascontiguousarray(ties[:, 0]), b=np.ascontiguousarray(ties[:, 1])).select(KEPT)

    for batch in batches:
        packed = batch.column("packed").is_valid()
        yield batch.filter(pc.invert(packed)).select(KEPT)
        posted = batch.filter(packed)
        if not posted.num_rows:
            continue
        keys, docs = _unpacked(posted)
        last = posted.column("slot")[-1].as_py()
        if last != now:
            own = keys >> np.uint64(8 * KEY_BYTES) == np.uint64(last)
            held.append((keys[~own], docs[~own]))
            tie()
            if sum(map(len, made)) > MOST_TIES:
                yield told()
            held, now, keys, docs = [], last, keys[own], docs[own]
        held.append((keys, docs))
    if held:
        tie()
    yield told()


def _pressed(batches):
    press = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        keys, out = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            keys.append(doc_key(doc_id, raw))
            out.append(press.compress(raw))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["doc", "pressed"])


def link_sets(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the same sets as all links do. Sets are numbered by size, so lists are ordered by size."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    if len(order) < 2:
        return []
    _, tokens = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    stops = np.cumsum(sizes)
    own = [tokens[b - n : b] for n, b in zip(sizes.tolist(), stops.tolist(), strict=True)]
    owner = np.repeat(np.arange(len(order)), sizes)
    by = np.argsort(tokens, kind="stable")
    members = owner[by]
    listed = tokens[by].astype(np.int64) * len(order) + members  # ascending: lists by token, each by set number
    parent = list(range(len(order)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def counted(which, low, high):
        """How often each set with a number in [low, high) stands in the lists of these tokens."""
        heads = np.searchsorted(listed, which * len(order) + low)
        n = np.searchsorted(listed, which * len(order) + high) - heads
        at = np.repeat(heads - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(members[at] - low, minlength=high - low)

    links, before, counts, least, most = [], None, None, 0, 0
    for i in sorted(range(len(order)), key=lambda i: (int(own[i][0]), int(own[i][-1]), len(own[i]))):
        low = int(np.searchsorted(sizes, -(-percent * sizes[i] // 100)))
        high = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        if before is not None:
            gone, come = np.setdiff1d(own[before], own[i], True), np.setdiff1d(own[i], own[before], True)
        if before is not None and least <= low and high <= most and len(gone) + len(come) < len(own[i]) // 2:
            counts = counts - counted(gone, least, most) + counted(come, least, most)
        else:
            # A little more than this set's sizes, so that the next set's are mostly among them.
            least = int(np.searchsorted(sizes, percent * sizes[i] * 19 // 2000))
            most = int(np.searchsorted(sizes, sizes[i] * 2100 // (20 * percent), "right"))
            counts = counted(own[i], least, most)
        before = i
        near = counts[low - least : high - least]
        for j in (np.flatnonzero((100 + percent) * near >= percent * (sizes[low:high] + sizes[i])) + low).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((ids[order[i]], ids[order[j]]))
    return links


def _link_rows(k: int, percent: int):
    """From rows sorted by group: the connecting links of each group's sets. Texts are held only until their sets are made."""

    def run(batches):
        press, known = zstandard.ZstdDecompressor(), rc.Names()
        now, sets, waiting, size, out = None, {}, {}, 0, []

        def parse():
            nonlocal size
            sets.update(zip(waiting, shingle_sets(list(waiting.values()), k, known), strict=True))
            waiting.clear()
            size = 0

        def linked():
            parse()
            found = link_sets(list(sets), list(sets.values()), percent)
            sets.clear()
            return found

        for batch in batches:
            for which, doc, pressed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if which != now:
                    out += linked()
                    now = which
                if doc not in sets and doc not in waiting:
                    waiting[doc] = press.decompress(pressed)
                    size += len(waiting[doc])
                    if size > CHUNK_BYTES:
                        parse()
            yield _edges(out)
            out = []
        yield _edges(linked())

    return run


def _edges(pairs):
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


KEPT = ["a", "b", "_id", "n_shingles", "mark"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, shingles: int = LARGEST_SHINGLES) -> DataFrame:
    """(doc, _id, n_shingles, component): component is the smallest document key reachable by links."""
    rows = _rows(docs, id_col, text_col)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, k))
    # One pass for both, as a second scan may cut other blocks, and what is posted depends on them. What is stored are the ties alone.
    found = rows.mapInArrow(_set_rows(k, percent, common), FOUND).repartition("slot").sortWithinPartitions("slot")
    found = materialize(found.mapInArrow(_tie_rows, "a bigint, b bigint, _id bigint, n_shingles bigint, mark bigint"), "sets")
    clusters = components(found.filter("n_shingles is null").select("a", "b"))
    # Equal sets are one from here on: the smallest document with the set stands for all, its twins.
    marked = found.filter("n_shingles is not null").select(F.col("a").alias("doc"), "_id", "n_shingles", "b", "mark")
    one = marked.groupBy("b", "mark").agg(F.min("doc").alias("twin"))
    sized = materialize(marked.join(one, ["b", "mark"]).select("doc", "_id", "n_shingles", "twin"), "sized")
    ratio = 100 / (percent - 1)  # a little over the largest ratio of linked sizes, so that linked sets are at most one band apart
    known = small(clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster")))
    members = sized.filter("n_shingles > 0 and doc = twin").select("doc", "n_shingles").distinct().join(known, "doc")
    members = members.withColumn("own_band", F.floor(F.log("n_shingles") / math.log(ratio)).cast("int"))
    members = materialize(members.withColumn("band", F.explode(F.array(F.col("own_band"), F.col("own_band") - 1))), "members", few=True)
    counts = members.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("band") == F.col("own_band"), 1)).alias("n_own"), F.sum("n_shingles").alias("mass")).filter("n > 1 and n_own > 0")
    counts = materialize(counts, "member-counts", few=True)
    wanted = F.least(F.ceil(F.col("n") / block), F.lit(MOST_BLOCKS))
    blocks = F.greatest(wanted, F.ceil(F.col("n") / LARGEST_BLOCK), F.ceil(F.col("mass") / shingles)).cast("int")
    placed = members.join(small(counts), ["cluster", "band"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    placed = materialize(placed.select("doc", "cluster", "band", "blocks", "own"), "placed", few=True)
    texts = rows.mapInArrow(_pressed, "doc bigint, pressed binary").join(small(placed), "doc")
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("cluster", "band", F.least("own", "other"), F.greatest("own", "other"))
    grouped = texts.select(group.alias("group"), "doc", "pressed").repartition("group").sortWithinPartitions("group")
    linked = components(grouped.mapInArrow(_link_rows(k, percent), "a bigint, b bigint"))
    linked = linked.withColumnsRenamed({"node": "twin", "component": "found"})
    return sized.join(small(linked), "twin", "left").select("doc", "_id", "n_shingles", F.coalesce("found", "twin").alias("component"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    found = classes(docs, id_col, text_col, k, percent)
    named = F.when(F.col("component") < NO_ID, F.col("component"))
    return found.select(F.col("_id").alias(id_col), "n_shingles", named.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with all their columns, one document of each component: the one with its smallest id.

    Rows with a null id stay, unless they are linked with a row that has one.
    """
    found = classes(docs, id_col, text_col, k, percent)
    gone = materialize(found.filter((F.col("doc") != F.col("component")) & ((F.col("doc") < NO_ID) | (F.col("component") < NO_ID))).select(F.col("doc").alias("_gone")).distinct(), "near-copies", few=True)
    repeated = materialize(found.filter("_id is not null").groupBy(F.col("_id").alias("_again")).count().filter("count > 1").select("_again"), "repeated-ids", few=True)
    gone, repeated = small(gone), small(repeated)
    own = docs.columns
    tagged = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(own)])
    at, text = f"_c{own.index(id_col)}", f"_c{own.index(text_col)}"

    @F.pandas_udf("bigint")
    def key(ids, texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([doc_key(None if i is None or i != i else i, (t or "").encode("utf-8", "surrogatepass")) for i, t in zip(ids, texts, strict=True)], dtype="int64")

    with_id = tagged.filter(F.col(at).isNotNull()).join(gone, F.col(at).cast("long") == F.col("_gone"), "left_anti")
    without = tagged.filter(F.col(at).isNull()).withColumn("_key", key(F.col(at), F.col(text))).join(gone, F.col("_key") == F.col("_gone"), "left_anti").drop("_key")
    # Only rows whose id comes again are brought together by it, so that the other texts stay where they are.
    again = F.col(at).cast("long") == F.col("_again")
    one = Window.partitionBy(at).orderBy(F.lit(1))
    several = with_id.join(repeated, again, "left_semi").withColumn("_row", F.row_number().over(one)).filter("_row = 1").drop("_row")
    return with_id.join(repeated, again, "left_anti").unionByName(several).unionByName(without).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)])
