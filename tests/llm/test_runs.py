"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from barloom.llm import queries, squares

SF = "/root/testdata/sf0.001"


def brute_runs(words, exponent=4, shortest=6):
    """(start, length, period) of the maximal runs, by smallest period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(shortest, exponent * q):
                found.setdefault((s, i + q - s), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def made(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        piece = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        out += piece * rng.choice([1, 1, 2, 4, 5, 9]) + piece[: rng.randint(0, len(piece))] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 3))]
    return out


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_catch_equals_brute_force(exponent):
    rng = random.Random(exponent)
    for _ in range(250):
        texts = [made(rng) for _ in range(rng.randint(1, 4))]
        shortest = rng.choice([2, 6])
        rows, out = squares._append(texts, exponent, shortest)
        for i, words in enumerate(texts):
            expected = brute_runs(words, exponent, shortest)
            assert [tuple(r[1:]) for r in rows.tolist() if r[0] == i] == expected
            assert out[i] == " ".join(collapsed(words, expected))


def test_false_names_are_tried_again(monkeypatch):
    """A run that words don't bear out is not reported: the append is repeated under another key."""
    keys, real = [], squares.Catchers.__init__

    def weak(self, words, key):
        real(self, words, key)
        keys.append(key)
        if key == 1:
            self.names[0] = self.names[0] * np.uint64(0)

    monkeypatch.setattr(squares.Catchers, "__init__", weak)
    rows = squares.catch(np.array([1, 2, 3, 4, 5, 1, 1, 1, 1, 1, 1, 9]), 12)
    assert keys == [1, 2] and rows.tolist() == [[5, 11, 1]]


def test_long_periods_and_long_texts():
    rng = np.random.default_rng(3)
    piece = rng.integers(0, 1000, 30_011)
    words = np.r_[rng.integers(0, 1000, 777), np.tile(piece, 4), piece[:13], np.full(50_000, 5), np.arange(2000, 2100)]
    rows = squares.catch(words, len(words)).tolist()
    assert [777, 777 + 4 * 30_011 + 13, 30_011] in rows and [r for r in rows if r[2] == 1] == [[777 + 4 * 30_011 + 13, 777 + 4 * 30_011 + 13 + 50_000, 1]]


def words_of(doc_id, text):
    """The words of a text after the planting that the query asks for."""
    words = squares.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = words_of(doc_id, text)
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(collapsed(words, runs))))


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, SF).collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows)
    for r in rows:
        if len(squares.WORD.findall(docs[r.doc_id] or "")) < 1500:
            assert tuple(r) == expected(r.doc_id, docs[r.doc_id])


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (3, " \n\t"), (None, "a a a a a a b"), (4, "a\x0ba a\ta a a\x85a"), (5, "x y " * 60_000), (50, "a b"), (59, "q"), (60, "a"), (61, "b c d e f g")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, runs long, collapsed string").repartition(3)
    found = squares.find_runs(docs.select("doc_id", squares.planted(docs["doc_id"], docs["text"]).alias("text"), "runs", "collapsed"))
    got = list(map(tuple, squares.digests(found).collect()))
    assert sorted((x for x in got if x[0] != 5), key=str) == sorted((expected(*r) for r in rows if r[0] != 5), key=str)
    long = next(x for x in got if x[0] == 5)
    assert long[1] == 1 and long[4] == 2 and long[3] == 120_000
    assert squares.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="exponent"):
        squares.find_runs(docs, exponent=1)
