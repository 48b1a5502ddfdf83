"""SentencePiece BPE encoding by a prefix table, and decoding.

For each prefix of a unit of text the table stores the last token of the prefix's own encoding. It is unique: of the pieces
that end there (an automaton's matches), the one that is compatible with the token stored for the prefix before it. Two
tokens are compatible if merging, run over their joined text, ends in just these two, so that no merge ever crosses their
border; this is found once for each pair and kept. The ids are then read off backwards, from the last prefix on.

A text is cut into units where no piece can reach across: before each run of spaces, between letters and punctuation, and
around characters that stand in no longer piece. The tables of many units are filled together, one prefix length after the
other; units that are long or hold characters that are no piece, which are given as byte pieces, go one by one. Units
repeat, so their ids are kept, in two generations of bounded size.

Defined results: a null or empty text has no ids but the begin and end ids asked for; repeated rows are encoded as often as
they come; a null id stays null; an empty table gives no rows; other columns are ignored. A text of any length takes time
and memory in proportion.
"""

from __future__ import annotations

import functools
import itertools
import re
import string
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
KEPT_UNITS, KEPT_PAIRS, LONG_UNIT = 150_000, 100_000, 64
#: Slots of the table of pairs that many look-ups share: a power of two, 9 bytes each.
SLOTS = 1 << 21
#: Characters of texts encoded together.
GROUP = 1_000_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # piece types of the file format
_START = -1


class PieceBpe:
    _one: dict[str, PieceBpe] = {}

    @classmethod
    def cached(cls, path: str) -> PieceBpe:
        if path not in cls._one:
            cls._one[path] = cls(path)
        return cls._one[path]

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        told = model.normalizer_spec
        plain = told.add_dummy_prefix and told.escape_whitespaces and not told.remove_extra_whitespaces and not told.precompiled_charsmap
        if model.trainer_spec.model_type != 2 or not plain or model.trainer_spec.treat_whitespace_as_suffix or {p.type for p in model.pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only BPE models of normal and byte pieces, with a prefix space and without normalization, are read")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        if len(self.bytes) < 256:
            raise ValueError("the model has no piece for each byte")
        unknown = model.trainer_spec.unk_surface.encode()
        surface = {_NORMAL: lambda p: p.replace(SPACE, " ").encode(), _UNKNOWN: lambda _: unknown, _CONTROL: lambda _: b"", _BYTE: lambda p: bytes([int(p[3:-1], 16)])}
        self.surfaces = [surface[p.type](p.piece) for p in model.pieces]
        self.slot_keys, self.slot_fits = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds every piece in a text, as its id and length in one number."""
        found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            found.add_word(piece, i << 8 | len(piece))
        found.make_automaton()
        return found

    @functools.cached_property
    def longer(self) -> ahocorasick.Automaton:
        """Finds the pieces of two characters and more; what is one character long `single` tells."""
        found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) > 1:
                found.add_word(piece, i << 8 | len(piece))
        found.make_automaton()
        return found

    @functools.cached_property
    def single(self) -> np.ndarray:
        """The piece of each character alone, by code point; -1 if it is none."""
        out = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                out[ord(piece)] = i
        return out

    @functools.cached_property
    def units(self) -> re.Pattern:
        """Cuts a text where the vocabulary lets no piece reach across."""
        longer = [p for p in self.ids if len(p) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer):
            return re.compile("(?s:.+)")
        held = set("".join(longer))
        loners = {chr(c) for c in range(128)} - held
        # ASCII letters, and ASCII punctuation: neither beside the other in a piece, so cut between, unless one does that.
        marks, letters = (set(string.punctuation) | {"\r"}) - loners, set(string.ascii_letters)
        kind = {**dict.fromkeys(marks, 1), **dict.fromkeys(letters, 2)}
        apart = all({kind.get(x), kind.get(y)} != {1, 2} for p in longer for x, y in itertools.pairwise(p))
        of = lambda chars: "".join(map(re.escape, sorted(chars)))
        plain = f"{SPACE}*[{of(letters)}]+(?=[{SPACE}{of(loners | marks)}]|\\Z)|{SPACE}*[{of(marks)}]+(?=[{SPACE}{of(loners | letters)}]|\\Z)|" if apart else ""
        return re.compile(f"{plain}{SPACE}*[^{SPACE}{of(loners)}]+|{SPACE}+" + (f"|[{of(loners)}]" if loners else ""))

    @functools.cached_property
    def apart(self) -> str:
        """A character that stands in no piece."""
        held = set("".join(self.ids))
        return next(chr(c) for c in range(0xE000, 0xF900) if chr(c) not in held)

    def merged(self, text: str, steps: list[tuple[float, list[str]]] | None = None) -> list[str]:
        """The symbols left when the best-scored pair of neighbours, leftmost first, is merged until none is a piece;
        steps gets each merge's score and the symbols after it."""
        left = list(text)
        while True:
            best, at = None, -1
            for i in range(len(left) - 1):
                score = self.scores.get(left[i] + left[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return left
            left[at : at + 2] = [left[at] + left[at + 1]]
            if steps is not None:
                steps.append((best, list(left)))

    @functools.lru_cache(maxsize=None)  # noqa: B019, one entry a piece
    def edges(self, token: int) -> tuple[bool, list, list] | None:
        """How a piece grows from its characters: whether its merges come in falling order of score, and the symbols at its
        first and last place, each with the scores between which it stands there. None if its own merges don't make it."""
        piece, steps = self.pieces[token], []
        if self.merged(piece, steps) != [piece]:
            return None
        scores = [score for score, _ in steps]
        sides = []
        for place in (0, -1):
            side = [[piece[place], np.inf, -np.inf]]
            for score, left in steps:
                if left[place] != side[-1][0]:
                    side[-1][2] = score
                    side.append([left[place], score, -np.inf])
            sides.append([tuple(x) for x in side])
        return all(x > y for x, y in itertools.pairwise(scores)), *sides

    def fits(self, before: int, token: int) -> bool:
        """Whether the token may follow the one before; below 0 stand a unit's start and characters that are no piece.

        Merges inside two tokens don't touch each other, so their joined text comes out otherwise only if at some score the
        last symbol of the one and the first of the other both stand, and merge better than either is merged away. Where
        scores tie or don't fall, the joined text is merged as a whole."""
        edge = self.edges(token)
        if before < 0 or edge is None:
            return edge is not None
        other = self.edges(before)
        if other is None or self.pieces[before] + self.pieces[token] in self.ids:
            return False
        whole = not (edge[0] and other[0])
        for last, born, gone in () if whole else other[2]:
            for first, born_too, gone_too in edge[1]:
                score = self.scores.get(last + first)
                if score is not None:
                    until, since = max(gone, gone_too), min(born, born_too)
                    if until == since or score == until:
                        whole = True
                    elif until < since and score > until:
                        return False
        own = [self.pieces[before], self.pieces[token]]
        return not whole or self.merged("".join(own)) == own

    @functools.cached_property
    def kept_fits(self) -> Callable[[int, int], bool]:
        return functools.lru_cache(maxsize=KEPT_PAIRS)(self.fits)

    def prefix_table(self, unit: str) -> tuple[list[int], list[int]]:
        """(last token, its characters) of each prefix; a character that is no piece counts as a token below the start."""
        ends: list[list[int]] = [[] for _ in unit]
        for end, piece in self.automaton.iter(unit):
            ends[end].append(piece)
        last, size, fits = [_START], [0], self.kept_fits
        for end, found in enumerate(ends, 1):
            for piece in found:
                if fits(last[end - (piece & 255)], piece >> 8):
                    last.append(piece >> 8)
                    size.append(piece & 255)
                    break
            else:
                last.append(_START - 1)
                size.append(1)
        return last, size

    def unit_ids(self, unit: str) -> bytes:
        last, size = self.prefix_table(unit)
        out, end = [], len(unit)
        while end:
            if last[end] >= 0:
                out.append(last[end])
            else:
                out += [self.bytes[b] for b in reversed(unit[end - 1].encode())]
            end -= size[end]
        return np.array(out[::-1], "<u4").tobytes()

    def _fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """`fits` of many pairs. A slot holds the last pair asked for of those that share it."""
        keys = np.maximum(before + 1, 0) << 24 | token
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        out, new = self.slot_fits[slot], np.flatnonzero(self.slot_keys[slot] != keys)
        if len(new):
            asked, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            told = np.fromiter((self.fits((k >> 24) - 1, k & 0xFFFFFF) for k in asked.tolist()), bool, len(asked))
            out[new] = told[back]
            at = slot[new][first]
            self.slot_keys[at], self.slot_fits[at] = asked, told
        return out

    def tables(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, last, size): the prefix tables of many units, one behind the other; the prefix of n characters of a
        unit is at its start plus n."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = self.apart.join([*units, ""])
        found = np.fromiter(itertools.chain.from_iterable(self.longer.iter(text)), np.int64).reshape(-1, 2)
        alone = self.single[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        at = np.flatnonzero(alone >= 0)
        end, token = np.r_[at, found[:, 0]] + 1, np.r_[alone[at].astype(np.int64), found[:, 1] >> 8]
        length = np.r_[np.ones(len(at), np.int64), found[:, 1] & 255]
        begin = end - length
        nth = end - np.repeat(starts, lengths + 1)[end]
        last, size = np.full(len(text), _START - 1), np.ones(len(text), np.int64)
        last[starts] = _START
        order = np.argsort(nth, kind="stable")
        for now in np.split(order, np.flatnonzero(np.diff(nth[order])) + 1):
            now = now[self._fit(last[begin[now]], token[now])]
            last[end[now]], size[end[now]] = token[now], length[now]
        return starts, last, size

    def learn(self, units: list[str]) -> None:
        """Keeps the ids of short units."""
        starts, last, size = self.tables(units)
        at = starts + np.fromiter(map(len, units), np.int64, len(units))
        live, owners, tokens = np.arange(len(units)), [], []
        while len(live):
            owners.append(live)
            tokens.append(last[at[live]])
            at[live] -= size[at[live]]
            live = live[at[live] > starts[live]]
        owner, token = np.concatenate(owners)[::-1], np.concatenate(tokens)[::-1]
        odd = set(owner[token < 0].tolist())
        order = np.argsort(owner, kind="stable")
        ids, bounds = token[order].astype("<u4").tobytes(), (4 * np.r_[0, np.cumsum(np.bincount(owner, minlength=len(units)))]).tolist()
        for i, unit in enumerate(units):
            self.young[unit] = self.unit_ids(unit) if i in odd else ids[bounds[i] : bounds[i + 1]]

    def encode_all(self, texts: Iterable[str | None], marked: bool = False) -> Iterator[bytes]:
        """The ids of each text, without begin and end, as little-endian unsigned 32-bit numbers. marked: texts are parts of
        one that begin as they are, without a space put before them."""
        group, size = [], 0
        for text in texts:
            group.append(self.units.findall(("" if marked else SPACE) + text.replace(" ", SPACE)) if text else [])
            size += len(text or "")
            if size > GROUP:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[bytes]:
        asked = set().union(*group)
        if len(self.young) + len(asked) > KEPT_UNITS:
            self.old, self.young = self.young, {}
        new = []
        for unit in asked:
            if unit not in self.young:
                found = self.old.get(unit)
                if found is None and len(unit) <= LONG_UNIT:
                    new.append(unit)
                else:
                    self.young[unit] = self.unit_ids(unit) if found is None else found
        if new:
            self.learn(new)
        for units in group:
            yield b"".join(map(self.young.__getitem__, units))
        for unit in [u for u in self.young if len(u) > LONG_UNIT] if len(self.young) > KEPT_UNITS else []:
            del self.young[unit]

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids say nothing, the first piece loses one leading space, bytes that are not UTF-8 each
        become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        first = next((i for i, n in enumerate(numbers) if self.kinds[n] != _CONTROL), len(numbers))
        made = [self.surfaces[n] for n in numbers[first:]]
        if made and self.kinds[numbers[first]] == _NORMAL and made[0].startswith(b" "):
            made[0] = made[0][1:]
        try:
            return b"".join(made).decode()
        except UnicodeDecodeError:
            return self._with_broken(made, [self.kinds[n] for n in numbers[first:]])

    @staticmethod
    def _with_broken(made: list[bytes], kinds: list[int]) -> str:
        out, held = [], b""

        def flush():
            nonlocal held
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[:n].decode())
                        held = held[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    held = held[1:]

        for piece, kind in zip(made, kinds, strict=True):
            if kind == _BYTE:
                held += piece
            else:
                flush()
                out.append(piece.decode())
        flush()
        return "".join(out)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", begin_end: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit numbers, with the begin and end ids if asked for."""

    def run(batches):
        bpe = PieceBpe.cached(model)
        before, after = (np.array([i], "<u4").tobytes() if begin_end else b"" for i in (bpe.begin, bpe.end))
        for batch in batches:
            ids = [before + made + after for made in bpe.encode_all(text.as_py() for text in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded's rows (doc_id, n_tokens, ids) with the ids' text as `decoded`; null ids have none."""

    def run(batches):
        bpe = PieceBpe.cached(model)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")
