"""Streams written here bit by bit: checks of all layers, free-format frames, tags of all versions, seek tables."""

import numpy as np
from barloom.llm import mpeg


def crc_of_bits(bits):
    crc = 0xFFFF
    for b in bits:
        top = (crc >> 15) ^ b
        crc = (crc << 1) & 0xFFFF
        if top:
            crc ^= 0x8005
    return crc


def bits_of(value, n):
    return [value >> (n - 1 - i) & 1 for i in range(n)]


def frame(head, covered, length):
    """A protected frame: header, check of its last two bytes and the covered bits, those bits, zeros."""
    crc = crc_of_bits(bits_of(int.from_bytes(head[2:4], "big"), 16) + covered)
    body = covered + [0] * (-len(covered) % 8)
    raw = head + crc.to_bytes(2, "big") + int("".join(map(str, body)), 2).to_bytes(len(body) // 8, "big")
    return raw + bytes(length - len(raw))


def checked(one, times=3):
    index = mpeg.index_stream(one * times)
    assert len(index["offsets"]) == times and index["junk"] == 0
    return index["crc_ok"], index["crc_bad"]


def damaged(one, bit):
    raw = bytearray(one)
    raw[6 + bit // 8] ^= 0x80 >> bit % 8
    return bytes(raw)


def test_layer_one_checks():
    rng = np.random.default_rng(1)
    for mode, n in ((0, 256), (0x40, 4 * (32 + 4)), (0x70, 4 * (32 + 16)), (0xC0, 128)):
        head = bytes([0xFF, 0xFE, 12 << 4, mode])  # 384 kbit/s, 44.1 kHz
        one = frame(head, rng.integers(0, 2, n).tolist(), 12000 * 384 // 44100 * 4)
        assert checked(one) == (3, 0) and checked(damaged(one, n - 1)) == (0, 3) and checked(damaged(one, n)) == (3, 0)


def layer_two(widths, channels, bound, rng):
    covered, picked = [], 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            value = int(rng.integers(0, 1 << width)) if rng.random() < 0.7 else 0
            covered += bits_of(value, width)
            picked += (1 if band < bound else channels) if value else 0
    return covered + rng.integers(0, 2, 2 * picked).tolist()


def test_layer_two_checks():
    rng = np.random.default_rng(2)
    a, b = [4] * 11 + [3] * 12 + [2] * 4, [4] * 11 + [3] * 12 + [2] * 7
    c, d, low = [4] * 2 + [3] * 6, [4] * 2 + [3] * 10, [4] * 4 + [3] * 7 + [2] * 19
    for byte1, index, rate, mode, widths, channels, bound, length in (
        (0xFC, 10, 0, 0x00, b, 2, 32, 144 * 192 * 1000 // 44100),
        (0xFC, 8, 0, 0x50, a, 2, 8, 144 * 128 * 1000 // 44100),
        (0xFC, 10, 1, 0x60, a, 2, 12, 144 * 192 * 1000 // 48000),
        (0xFC, 2, 0, 0xC0, c, 1, 32, 144 * 48 * 1000 // 44100),
        (0xFC, 2, 2, 0xC0, d, 1, 32, 144 * 48 * 1000 // 32000),
        (0xF4, 8, 0, 0x00, low, 2, 32, 144 * 64 * 1000 // 22050),
    ):
        covered = layer_two(widths, channels, bound, rng)
        one = frame(bytes([0xFF, byte1, index << 4 | rate << 2, mode]), covered, length)
        assert checked(one) == (3, 0) and checked(damaged(one, len(covered) - 1)) == (0, 3)


def test_free_format():
    plain, longer = bytes([0xFF, 0xFB, 0x08, 0xC0]), bytes([0xFF, 0xFB, 0x0A, 0xC0])
    stream = b"".join(h + bytes(n - 4) for h, n in ((plain, 700), (longer, 701), (plain, 700), (plain, 700)))
    index = mpeg.index_stream(b"\xff\xfb\x08\xc0 junk" + stream)
    assert index["offsets"] == [9, 709, 1410, 2110] and index["junk"] == 9 and index["samples"] == 4 * 1152 and index["kbps"] == {155}
    assert mpeg.index_stream(plain + bytes(3000))["offsets"] == [] and mpeg.index_stream(plain + bytes(100) + plain + bytes(50))["offsets"] == []


def sound(times):
    return (bytes([0xFF, 0xFB, 0x98, 0xC0]) + bytes(572)) * times  # 128 kbit/s, 32 kHz, mono


def test_tags_of_all_versions():
    text = b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + b"\0a\xff\0\xe0b"[:6]
    big = lambda n: mpeg._synchsafe(n)
    stuffed = text.replace(b"\xff", b"\xff\0")
    extended = (6).to_bytes(4, "big") + bytes(6)
    for tag in (
        b"ID3\x03\0\x80" + big(len(stuffed)) + stuffed,
        b"ID3\x03\0\x40" + big(len(extended + text)) + extended + text,
        b"ID3\x04\0\x50" + big(6 + len(text)) + big(6) + b"\1\0" + text + b"3DI" + bytes(7),
        b"ID3\x02\0\0" + big(12) + b"TT2" + (6).to_bytes(3, "big") + text[10:],
    ):
        index = mpeg.index_stream(tag + sound(3))
        assert index["offsets"] == [len(tag) + 576 * i for i in range(3)] and index["junk"] == 0
        assert index["tags"].get("TIT2", index["tags"].get("TT2", "")).startswith("a\xff")


def test_seek_tables():
    head = bytes([0xFF, 0xFB, 0x98, 0xC0])
    xing = b"Xing" + (7).to_bytes(4, "big") + (4).to_bytes(4, "big") + (5 * 576).to_bytes(4, "big") + bytes(min(255, 51 + 2 * i) for i in range(100))
    first = head + bytes(17) + xing
    index = mpeg.index_stream(first + bytes(576 - len(first)) + sound(4))
    assert index["table"] == ("Xing", 4, 5 * 576, 100) and index["seek"][0] == 51 * 5 * 576 // 256 and len(index["seek"]) == 100 and len(index["offsets"]) == 4
    vbri = b"VBRI" + b"\0\1" + bytes(4) + (5 * 576).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (4, 2, 2, 1)) + b"".join(x.to_bytes(2, "big") for x in (288, 288, 288, 288))
    first = head + bytes(32) + vbri
    index = mpeg.index_stream(first + bytes(576 - len(first)) + sound(4))
    assert index["table"] == ("VBRI", 4, 5 * 576, 4) and index["seek"] == [576, 1152, 1728, 2304] and index["offsets"] == [576, 1152, 1728, 2304]
    stored = mpeg.index_stream(mpeg.store_payload(bytes(range(256)) * 500))
    assert len(stored["seek"]) == 100 and all(x <= y for x, y in zip(stored["seek"], stored["seek"][1:]))
