"""Media columns: MPEG audio streams in a binary column.

`index_stream` reads a stream the way a player does: ID3v2.2 to 2.4 tags (unsynchronised ones, extended headers and
footers too) and ID3v1, resynchronisation on frame headers (a header counts when the frame it announces ends at another
header of the same kind or at the end), free-format frames (their length is the distance to the next like header, which
a third must confirm), Xing/Info and VBRI tables with their seek entries as byte offsets, the CRC-16 of protected frames
of all three layers, then exact duration (samples over rate) and the byte offset of every frame. `store_payload` is the lossless writer: silent, CRC-protected MPEG-1 Layer III frames whose ancillary bytes are
the payload, 320 kbit/s but for the last, which is the smallest that fits (so the stream is VBR and has a Xing table);
the payload's length stands in an ID3v2 TXXX tag.

Defined results: null or empty binaries have no frames, zero duration and empty tables; bytes outside frames are counted
as junk; damaged frames fail their CRC and are counted, not dropped; truncated last frames are junk; equal inputs give
equal outputs; other columns are passed through by `media_index`, and clashes with its own column raise. A very
long text is one payload: its stream is built and read in one task, a few times its size, and in time linear in it.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, for MPEG-1 layers I, II, III and MPEG-2 I, II/III.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Fixed values of the same standards' Layer II allocation tables: (subbands, bits of an allocation) in order.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}

#: The longest frame of any fixed rate, which bounds a free-format frame too.
LONGEST_FRAME = 2884

MONO_SIDE = 17
RATE_32K = 2
PAYLOAD_UNIT = 64


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        table.append(crc & 0xFFFF)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ byte]
    return crc


@lru_cache(maxsize=4096)
def parse_header(head: bytes):
    """(length, samples, rate, kbps, layer, protected, side bytes, kind) of a 4-byte header, or None; a free-format frame's length is 0."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = (head[1] >> 3) & 3, 4 - ((head[1] >> 1) & 3)
    index, rate_index = head[2] >> 4, (head[2] >> 2) & 3
    if version == 1 or layer == 4 or index == 15 or rate_index == 3 or head[3] & 3 == 2:
        return None
    first = version == 3
    kbps, rate, pad = KBPS[1 if first else 2, layer][index], RATES[version][rate_index], (head[2] >> 1) & 1
    mono = head[3] >> 6 == 3
    if layer == 1:
        length, samples = (12000 * kbps // rate + pad) * 4 if index else 0, 384
    else:
        samples = 1152 if layer == 2 or first else 576
        length = samples // 8 * 1000 * kbps // rate + pad if index else 0
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return length, samples, rate, kbps, layer, not head[1] & 1, side if layer == 3 else 0, (version, layer, rate_index, index == 0)


def _padding(data: bytes, at: int, layer: int) -> int:
    return (data[at + 2] >> 1 & 1) * (4 if layer == 1 else 1)


def _free_size(data: bytes, at: int, end: int, head) -> int:
    """Bytes of the free-format frame at `at` without its padding, or 0 if no like headers follow."""
    layer, side, kind = head[4], head[6], head[7]
    sync, own = bytes(data[at : at + 2]), _padding(data, at, layer)
    near = at + 4 + side
    while (near := data.find(sync, near, min(end, at + LONGEST_FRAME))) >= 0:
        after = parse_header(bytes(data[near : near + 4]))
        if after is not None and after[7] == kind:
            size = near - at - own
            third = near + size + _padding(data, near, layer)
            after = parse_header(bytes(data[third : third + 4]))
            if third == end or third < end and after is not None and after[7] == kind:
                return size
        near += 1
    return 0


def _protected_bits(frame: bytes, layer: int, kbps: int, rate: int, lsf: bool) -> int:
    """How many bits behind the CRC word it covers, in a Layer I or II frame."""
    channels, joint = (1 if frame[3] >> 6 == 3 else 2), frame[3] >> 6 == 1
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if joint else 32
    if layer == 1:
        return 4 * (32 + (channels - 1) * bound)
    each = kbps / channels
    if lsf:
        table = "lsf"
    elif 56 <= each <= 80 or rate == 48000 and each >= 56:
        table = "a"
    elif each >= 96:
        table = "b"
    else:
        table = "d" if rate == 32000 else "c"
    bits, at, picked, band = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big"), 0, 0, 0
    for bands, width in ALLOCATION[table]:
        for _ in range(bands):
            for _ in range(channels if band < bound else 1):
                at += width
                if bits >> (512 - at) & ((1 << width) - 1):
                    picked += 1 if band < bound else channels
            band += 1
    return at + 2 * picked


def _crc_of(frame: bytes, layer: int, side: int, kbps: int, rate: int, lsf: bool) -> int:
    """The CRC-16 that a protected frame should carry."""
    if layer == 3:
        return crc16(frame[2:4] + frame[6 : 6 + side])
    whole, rest = divmod(_protected_bits(frame, layer, kbps, rate, lsf), 8)
    crc = crc16(frame[2:4] + frame[6 : 6 + whole])
    for i in range(rest):
        bit = (crc >> 15) ^ (frame[6 + whole] >> (7 - i) & 1 if 6 + whole < len(frame) else 0)
        crc = (crc << 1) & 0xFFFF ^ (0x8005 if bit else 0)
    return crc


def _synchsafe_value(b: bytes) -> int:
    return sum((x & 0x7F) << 7 * i for i, x in enumerate(reversed(b)))


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Where the audio begins, and the text frames of the tag."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    version, flags, tags = data[3], data[5], {}
    body = bytes(data[10 : 10 + _synchsafe_value(data[6:10])])
    audio = min(len(data), 10 + len(body) + (10 if version >= 4 and flags & 0x10 else 0))
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    name_size, head_size = (3, 6) if version == 2 else (4, 10)
    at = 0
    if flags & 0x40 and version >= 3:
        at = _synchsafe_value(body[:4]) if version >= 4 else 4 + int.from_bytes(body[:4], "big")
    while at + head_size <= len(body) and body[at : at + name_size].strip(b"\0"):
        name, raw = body[at : at + name_size].decode("latin-1"), body[at + name_size : at + 2 * name_size]
        size = _synchsafe_value(raw) if version >= 4 else int.from_bytes(raw, "big")
        value = body[at + head_size : at + head_size + size]
        if version >= 4:
            value = value[4:] if body[at + 9] & 1 else value  # the value's length before unsynchronisation
            value = value.replace(b"\xff\0", b"\xff") if body[at + 9] & 2 or flags & 0x80 else value
        if name[:1] == "T" and value:
            parts = value[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), "replace").split("\0")
            if name in ("TXXX", "TXX") and len(parts) > 1:
                tags[parts[0]] = parts[1].lstrip("\ufeff")
            else:
                tags[name] = parts[0]
        at += head_size + size
    return audio, tags


def _table(frame: bytes, at: int):
    """A Xing, Info or VBRI table in this frame: kind, frames, bytes, number of seek entries, their byte offsets from the frame."""
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at_value, found = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, [frame[at : at + 4].decode(), None, None]
        for bit in (0, 1):
            if flags >> bit & 1:
                found[1 + bit] = int.from_bytes(frame[at_value : at_value + 4], "big")
                at_value += 4
        steps = frame[at_value : at_value + 100] if flags & 4 else b""
        return (*found, 100 if flags & 4 else 0, [x * found[2] // 256 for x in steps] if found[2] else [])
    if frame[36:40] == b"VBRI":
        size, frames, entries, scale, width = (int.from_bytes(frame[i:j], "big") for i, j in ((46, 50), (50, 54), (54, 56), (56, 58), (58, 60)))
        seen, seek = 0, []
        for i in range(entries if width else 0):
            step = frame[62 + width * i : 62 + width * (i + 1)]
            if len(step) < width:
                break
            seen += int.from_bytes(step, "big") * scale
            seek.append(seen)
        return "VBRI", frames, size, entries, seek
    return None


def index_stream(data: bytes | None) -> dict:
    """Tags, tables, checks, exact duration and frame offsets of one stream."""
    data = data or b""
    at, tags = _id3v2(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) - 128 >= at else len(data)
    if end < len(data):
        tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    out = {"tags": tags, "table": None, "offsets": [], "lengths": [], "crc_ok": 0, "crc_bad": 0, "junk": 0, "samples": 0, "rate": 0, "kbps": set(), "sides": [], "seek": []}
    synced, free = None, 0
    while at + 4 <= end:
        head = parse_header(bytes(data[at : at + 4]))
        if head is not None and not head[0]:
            free = free if head[7] == synced else _free_size(data, at, end, head)
            length = free + _padding(data, at, head[4])
            head = (length, *head[1:3], length * 8 * head[2] // (head[1] * 1000), *head[4:]) if free else None
            good = head is not None and at + length <= end
        else:
            good = head is not None and at + head[0] <= end
            if good and head[7] != synced:
                after = parse_header(bytes(data[at + head[0] : at + head[0] + 4]))
                good = at + head[0] == end or after is not None and after[7] == head[7]
        if not good:
            synced = None
            skip = data.find(b"\xff", at + 1, end)
            out["junk"] += (end if skip < 0 else skip) - at
            at = end if skip < 0 else skip
            continue
        length, samples, rate, kbps, layer, protected, side, synced = head
        start = at + 4 + 2 * protected
        if protected:
            found = _crc_of(bytes(data[at : at + 70]), layer, side, kbps, rate, synced[0] != 3)
            out["crc_ok" if found == int.from_bytes(data[at + 4 : at + 6], "big") else "crc_bad"] += 1
        table = _table(data[at : at + length], start - at + side) if not out["offsets"] and out["table"] is None else None
        if table:
            out["table"], out["seek"] = table[:4], [at + x for x in table[4]]  # a table's frame holds no sound
        else:
            out["offsets"].append(at)
            out["lengths"].append(length)
            out["sides"].append(start + side)
            out["samples"] += samples
            out["rate"] = rate
            out["kbps"].add(kbps)
        at += length
    out["junk"] += max(0, end - at)
    return out


@lru_cache(maxsize=32)
def _silent_head(index: int) -> bytes:
    """Header, CRC and zeroed side information of a silent mono MPEG-1 Layer III frame at 32 kHz."""
    tail = bytes([index << 4 | RATE_32K << 2, 3 << 6])
    return b"\xff\xfa" + tail + crc16(tail + bytes(MONO_SIDE)).to_bytes(2, "big") + bytes(MONO_SIDE)


_SIZES = [0] + [144 * k // 32 for k in KBPS[1, 3][1:]]
_OVER = 4 + 2 + MONO_SIDE
_TABLE_INDEX = 4  # 56 kbit/s: room for the table


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def store_payload(payload: bytes) -> bytes:
    """A stream that carries payload, one byte of the format's ancillary data for each of its bytes."""
    text = b"\x03payload_bytes\0%d" % len(payload)
    frame = b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame
    room, parts, sizes = _SIZES[14] - _OVER, [], []
    for at in range(0, len(payload), room):
        body = payload[at : at + room]
        index = next(i for i in range(1, 15) if _SIZES[i] - _OVER >= len(body))
        parts.append(_silent_head(index) + body + bytes(_SIZES[index] - _OVER - len(body)))
        sizes.append(_SIZES[index])
    total = sum(sizes) + _SIZES[_TABLE_INDEX]
    reach, toc, seen = 0, bytearray(), _SIZES[_TABLE_INDEX]
    for hundredth in range(100):
        while reach < len(sizes) * hundredth // 100:
            seen += sizes[reach]
            reach += 1
        toc.append(min(255, seen * 256 // total))
    table = b"Xing" + (7).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(toc)
    head = _silent_head(_TABLE_INDEX) + table
    return tag + head + bytes(_SIZES[_TABLE_INDEX] - len(head)) + b"".join(parts)


def read_payload(data: bytes, index: dict | None = None) -> bytes:
    """The payload of a stream that store_payload wrote."""
    index = index or index_stream(data)
    body = b"".join(data[s : o + n] for s, o, n in zip(index["sides"], index["offsets"], index["lengths"], strict=True))
    return body[: int(index["tags"].get("payload_bytes", 0))]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % PAYLOAD_UNIT or (0 if raw else PAYLOAD_UNIT))


def describe(index: dict) -> str:
    seeks = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in index["offsets"]))
    table = index["table"] or ("-", 0, 0, 0)
    micros = index["samples"] * 1_000_000 // index["rate"] if index["rate"] else 0
    return (
        f"frames={len(index['offsets'])};samples={index['samples']};rate={index['rate']};us={micros};vbr={int(len(index['kbps']) > 1)};"
        f"crc_ok={index['crc_ok']};crc_bad={index['crc_bad']};junk={index['junk']};table={table[0]}:{table[1]}:{table[2]}:{table[3]};seek_crc32={seeks:08x}"
    )


INDEX_TYPE = (
    "struct<duration_us: bigint, samples: bigint, sample_rate: int, frames: bigint, seek_offsets: array<bigint>, "
    "vbr: boolean, table: string, table_frames: bigint, table_bytes: bigint, table_seek: array<bigint>, crc_ok: bigint, crc_bad: bigint, junk_bytes: bigint, tags: map<string, string>>"
)


def media_index(df: DataFrame, media_col: str, out_col: str = "media_index") -> DataFrame:
    """df with a struct column that indexes the MPEG audio in media_col."""
    if out_col in df.columns:
        raise ValueError(f"{out_col} is already a column")

    @F.pandas_udf(INDEX_TYPE)
    def indexed(streams):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = []
        for data in streams:
            x = index_stream(data)
            table = x["table"] or (None, None, None, 0)
            rows.append((x["samples"] * 1_000_000 // x["rate"] if x["rate"] else 0, x["samples"], x["rate"], len(x["offsets"]), x["offsets"], len(x["kbps"]) > 1, table[0], table[1], table[2], x["seek"], x["crc_ok"], x["crc_bad"], x["junk"], x["tags"]))
        return pd.DataFrame(rows, columns=[p.split(":")[0].strip() for p in _fields()])

    return df.withColumn(out_col, indexed(F.col(media_col)))


def _fields() -> list[str]:
    return ["duration_us", "samples", "sample_rate", "frames", "seek_offsets", "vbr", "table", "table_frames", "table_bytes", "table_seek", "crc_ok", "crc_bad", "junk_bytes", "tags"]


def _stored_batches(batches):
    for batch in batches:
        cols = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for text in batch.column(1).to_pylist():
            n, payload = padded(text)
            media = store_payload(payload)
            index = index_stream(media)
            back = read_payload(media, index)
            for k, v in zip(cols, (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(index)), strict=True):
                cols[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in cols.items())], names=["doc_id", *cols])


def stored_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as an MPEG stream, read back and indexed: digests and features, one row a document."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_stored_batches, schema)


def store_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and `media`, the binary stream that carries the text."""

    @F.pandas_udf("binary")
    def stored(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: store_payload(padded(t)[1]))

    return docs.select(F.col(id_col), stored(F.coalesce(F.col(text_col), F.lit(""))).alias("media"))
