"""Locally consistent names for token runs and pairs (recompression), as numpy over batches of documents.

Round 0 names runs of equal tokens; each later round splits all symbols into a left and a right half by one bit of a
hash and names every (left, right) neighbour pair. A token's name is a keyed digest of its bytes and a symbol's a
fingerprint of what it stands for, so all tasks give equal content equal names without a dictionary. With each symbol goes the range of tokens that determines it: the
same tokens anywhere else give the same symbol, which makes it an interior symbol of every window that holds that range.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np

ROUNDS = 4
MOST_NAMES = 60_000
KEY = b"names of tokens"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)
FAR = 1 << 40


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> _S)


class Names(dict):
    """Names of tokens: keyed 64-bit digests of their bytes, so no rule makes two tokens' names meet."""

    def __missing__(self, token: bytes) -> int:
        name = self[token] = int.from_bytes(hashlib.blake2b(token, digest_size=8, key=KEY).digest(), "little")
        return name


def tokens_of(raws: list[bytes], known: Names) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """(names, the number of tokens of each text, the tokens): maximal runs of bytes other than ASCII white space.

    known is emptied when it holds too many.
    """
    if len(known) > MOST_NAMES:
        known.clear()
    tokens = [raw.split() for raw in raws]
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(tokens)), np.uint64, counts.sum()), counts, tokens


def rounds(names: np.ndarray, docs: np.ndarray, n_rounds: int = ROUNDS):
    """Yields, per round, (symbol, low, high): low to high is the range of tokens that determines the symbol.

    names: tokens of several documents one after the other; docs: each token's document, ascending.
    """
    sym, doc = names, docs
    low = np.arange(len(names), dtype=np.int64)
    high = low + 1
    yield sym, low, high
    if not len(sym):
        return
    same = doc[1:] == doc[:-1]
    head = np.flatnonzero(np.r_[True, ~(same & (sym[1:] == sym[:-1]))])
    count = np.diff(np.r_[head, len(sym)])
    before = np.where(np.r_[False, same[head[1:] - 1]], low[head - 1], -FAR)
    last = head + count - 1
    after = np.where(np.r_[same[last[:-1]], False], high[np.minimum(last + 1, len(sym) - 1)], FAR)
    sym, doc, low, high = np.where(count > 1, mix(sym[head] + count.astype(np.uint64) * _M1), sym[head]), doc[head], before, after
    yield sym, low, high
    for turn in range(1, n_rounds):
        right = (mix(sym + np.uint64(turn * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)).astype(bool)
        same = np.r_[doc[1:] == doc[:-1], False]
        from_left = np.r_[False, same[:-1]]
        low2 = np.where(right, np.where(from_left, np.r_[0, low[:-1]], -FAR), low)
        high2 = np.where(right, high, np.where(same, np.r_[high[1:], 0], FAR))
        pair = np.flatnonzero(same[:-1] & ~right[:-1] & right[1:])
        made = mix(sym[pair] * _M1 + mix(sym[pair + 1]))
        keep = np.ones(len(sym), bool)
        keep[pair + 1] = False
        sym = sym.copy()
        sym[pair] = made
        low2[pair], high2[pair] = low[pair], high[pair + 1]
        sym, doc, low, high = sym[keep], doc[keep], low2[keep], high2[keep]
        yield sym, low, high


def anchors(names: np.ndarray, docs: np.ndarray, window: int, n_rounds: int = ROUNDS):
    """(windows, place, anchor): for each window (by first token) the lowest-named symbol of the highest round that has
    an interior symbol there; place is the symbol's own first determining token, so equal windows agree on all three."""
    n = len(names)
    first = np.arange(n - window + 1)
    first = first[docs[first] == docs[first + window - 1]] if n >= window else first[:0]
    todo, places, found = np.arange(len(first)), np.zeros(len(first), np.int64), np.zeros(len(first), np.uint64)
    levels = list(rounds(names, docs, n_rounds))
    for level in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        sym, low, high = levels[level]
        fine = (low > -FAR) & (high < FAR) & (high - low <= window)
        sym, low, high = sym[fine], low[fine], high[fine]
        at = first[todo]
        a, b = np.searchsorted(low, at, "left"), np.searchsorted(high, at + window, "right")
        some = b > a
        a, b, at = a[some], b[some], todo[some]
        best = _argmin(mix(sym + np.uint64(level)), a, b)
        places[at], found[at] = low[best], mix(sym[best] + np.uint64(level * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF))
        todo = todo[~some]
    return first, places, found


def _argmin(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leftmost index of the least value in each values[a:b], by a sparse table."""
    best = np.arange(len(values))
    out = np.zeros(len(a), np.int64)
    span = 1
    sizes = b - a
    while len(a):
        now = (sizes >= span) & (sizes < 2 * span)
        if now.any():
            p, q = best[a[now]], best[b[now] - span]
            out[now] = np.where(values[q] < values[p], q, p)
        if not (sizes >= 2 * span).any():
            break
        p, q = best[:-span], best[span:]
        best = np.where(values[q] < values[p], q, p)
        span *= 2
    return out


def window_digests(names: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of the windows that begin at first. Spans of 1, 2, 4... tokens are named in turn, each from
    its halves, and a window from the spans that its length is the sum of."""
    out = []
    for turn in (_M1, _M2):
        spans, size, whole, done = mix(names ^ turn), 1, None, 0
        while True:
            if window & size:
                part = spans[first + done]
                whole, done = part if whole is None else mix(whole * turn + part), done + size
            if 2 * size > window:
                break
            spans = mix(spans[:-size] * turn + mix(spans[size:])) if len(spans) > size else spans[:0]
            size *= 2
        out.append(whole)
    return out[0], out[1]
