"""Word-level encoding with a public BPE file, as bytes of little-endian unsigned 32-bit ids.

The tokenizers library is the reference; here its file's merges are applied to many words at once with numpy, and each
white-space-delimited word is encoded once and cached, which its pre-tokenizer allows (it drops white space and never
joins across it). A full cache keeps the half of its words used most, and a partition's end the most used few. Words beyond printable ASCII and Latin-1 letters, or very long ones, and texts with the
control characters that only Python splits on or with an added token's content, go to the library itself.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import regex

CACHE_WORDS, KEPT_WORDS = 300_000, 40_000
GROUP_CHARS = 2_000_000
LONG_WORD = 48
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_BEYOND = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
_MARK = r"[!-/:-@\[-`{-~]"
_CLOSING = re.compile(rf"{_MARK}(?<!{_MARK}{_MARK}){_MARK}*+(?=\s|\Z)")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next unused character from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class _Numbers(dict):
    """Numbers words as they are first looked up."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class WordBpe:
    _one: dict[str, WordBpe] = {}

    @classmethod
    def cached(cls, path: str) -> WordBpe:
        if path not in cls._one:
            cls._one[path] = cls(path)
        return cls._one[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.added = [t["content"] for t in file.get("added_tokens", [])]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.tables = self._tables()
        self.forget()

    def _tables(self):
        """Hash tables from pair to merge rank; what collides in the first is in the next, until none is left."""
        out, todo, turn = [], np.arange(len(self.keys)), 0
        while len(todo):
            slots = self._slot(self.keys[todo], turn)
            table = np.full(1 << 20, -1, np.int32)
            table[slots[::-1]] = todo[::-1]
            out.append(table)
            todo, turn = todo[table[slots] != todo], turn + 1
        return out

    @staticmethod
    def _slot(keys, turn):
        return (((keys * _A) ^ (keys >> np.uint64(17))) * (_B + np.uint64(2 * turn)) >> np.uint64(44)).astype(np.int64)

    def _ranks(self, left, right):
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        out, todo = np.full(len(keys), 1 << 30, np.int64), np.arange(len(keys))
        for turn, table in enumerate(self.tables):
            found = table[self._slot(keys[todo], turn)]
            hit = (found >= 0) & (self.keys[found] == keys[todo])
            out[todo[hit]] = found[hit]
            todo = todo[(found >= 0) & ~hit]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the non-empty pre-tokens, one after the other, and their bounds: every round merges the lowest-ranked pair of each unfinished word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            pair = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), 1 << 30, np.int64)
            at = np.flatnonzero(pair)
            rank[at] = self._ranks(symbols[at], symbols[at + 1])
            starts = np.flatnonzero(np.r_[True, ~pair])
            best = np.minimum.reduceat(rank, starts)
            of = np.repeat(best, np.diff(np.r_[starts, len(symbols)]))
            live = of < 1 << 30
            done_symbols.append(symbols[~live])
            done_owner.append(owner[~live])
            hit = np.flatnonzero(live & (rank == of))
            hit = hit[np.unique(owner[hit], return_index=True)[1]]
            symbols[hit] = self.made[rank[hit]]
            live[hit + 1] = False
            symbols, owner = symbols[live], owner[live]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        symbols = symbols[np.argsort(owner, kind="stable")].astype("<u4")
        return symbols, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]

    def forget(self) -> None:
        self.numbers, self.flat, self.starts, self.sizes, self.uses = _Numbers(), *(np.zeros(0, t) for t in ("<u4", np.int64, np.int64, np.int64))

    def keep(self, most: int) -> None:
        """Forgets all words but the `most` used most; their use counts by half, so that what was frequent long ago goes."""
        if len(self.numbers) <= most:
            return
        kept = np.sort(np.argpartition(-self.uses, most - 1)[:most]) if most else np.zeros(0, np.int64)
        words = list(self.numbers)
        self.numbers = _Numbers((words[i], n) for n, i in enumerate(kept.tolist()))
        self.flat, sizes = self._ids(kept), self.sizes[kept]
        self.starts, self.sizes, self.uses = np.cumsum(sizes) - sizes, sizes, self.uses[kept] // 2

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the words with these numbers, one after the other."""
        sizes = self.sizes[numbers]
        begins = np.repeat(self.starts[numbers] - np.cumsum(sizes) + sizes, sizes)
        begins += np.arange(len(begins))
        return self.flat[begins]

    def learn(self, words: list[str]) -> None:
        """Adds the ids of the words that were numbered last."""
        parts: dict[str, int] = _Numbers()
        split, odd = [], {}
        for n, word in enumerate(words):
            if len(word) > LONG_WORD or not (word.isascii() or _PLAIN.fullmatch(word)):
                odd[n] = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4")
                split.append(())
            elif word.isalpha():
                split.append((parts[word.lower()],))
            else:
                split.append([parts[x] for x in _SPLIT.findall(word.lower())])
        made, bounds = self.merge([p.encode() for p in parts]) if parts else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        n_parts = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter((x for s in split for x in s), np.int64, n_parts.sum())
        sizes = np.diff(bounds)[flat]
        at = np.repeat(bounds[flat] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        per_word = np.bincount(np.repeat(np.arange(len(words)), n_parts), sizes, len(words)).astype(np.int64)
        per_word[list(odd)] = [len(x) for x in odd.values()]
        ends = np.cumsum(per_word)
        ids = np.zeros(ends[-1], "<u4")
        plain = np.ones(len(ids), bool)
        for n, x in odd.items():
            ids[ends[n] - len(x) : ends[n]], plain[ends[n] - len(x) : ends[n]] = x, False
        ids[plain] = made[at]
        self.starts = np.r_[self.starts, len(self.flat) + ends - per_word]
        self.flat, self.sizes = np.r_[self.flat, ids], np.r_[self.sizes, per_word]
        self.uses = np.r_[self.uses, np.zeros(len(words), np.int64)]

    def encode(self, texts: list[str | None]):
        """The ids of each text, as bytes."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > GROUP_CHARS:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _words(self, text: str) -> list[str] | None:
        """Words to look up, or None for the library. Closing punctuation is a pre-token of its own, so it is set apart
        and the text lower-cased, where its letters allow that: far fewer different words are left."""
        if _ODD_SPACE.search(text) or any(t in text for t in self.added):
            return None
        return text.split() if _BEYOND.search(text) else _CLOSING.sub(r" \g<0>", text.lower()).split()

    def _encode(self, texts):
        known, found, told = len(self.numbers), [], []
        for text in texts:
            words = self._words(text)
            if words is None:
                told.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                told.append(None)
                found.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        if len(self.numbers) > known:
            self.learn(list(itertools.islice(self.numbers, known, None)))
        numbers = np.concatenate([*found, np.zeros(0, np.int64)])
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        ids, ends = self._ids(numbers).tobytes(), np.r_[0, np.cumsum(self.sizes[numbers]) * 4]
        stops = ends[np.cumsum([0, *map(len, found)])].tolist()
        which = iter(zip(stops[:-1], stops[1:], strict=True))
        for whole in told:
            if whole is None:
                a, b = next(which)
                whole = ids[a:b]
            yield whole
        if len(self.numbers) > CACHE_WORDS:
            self.keep(CACHE_WORDS // 2)
