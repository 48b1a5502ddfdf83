"""Substring de-duplication against brute force."""

import hashlib
import random
import re

import numpy as np
from barloom.llm import recompression, substrings


def brute(rows, window):
    """id -> (n_words, n_removed, kept) for rows of distinct (id, text), nulls first by the operator's key."""
    rows = sorted({(substrings.doc_key(i, (t or "").encode()), i, t or "") for i, t in rows})
    seen, words, gone = {}, {}, {}
    for key, _, text in rows:
        words[key] = re.findall(r"[^\x20\x09-\x0D]+", text)
        for s in range(len(words[key]) - window + 1):
            seen.setdefault(tuple(words[key][s : s + window]), (key, s))
    for key, _, _ in rows:
        gone[key] = {s + j for s in range(len(words[key]) - window + 1) if seen[tuple(words[key][s : s + window])] < (key, s) for j in range(window)}
    return {k: (len(w), len(gone[k]), " ".join(x for n, x in enumerate(w) if n not in gone[k])) for k, w in words.items()}


def check(spark, rows, window):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, doc string, begin int").repartition(3)
    got = substrings.dedup(df, window=window).collect()
    assert len(got) == len(rows)
    want = brute(rows, window)
    texts = sorted((r.n_words, r.n_removed, r.kept) for r in got if r.doc_id is None)
    assert texts == sorted(want[substrings.doc_key(None, (t or "").encode())] for i, t in rows if i is None)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id


def test_random_small_alphabets(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = [rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.randint(0, 90))]
        rows.append((i * 7 % 300, rng.choice([" ", "\n", " \t "]).join(words)))
    check(spark, rows, 20)
    check(spark, rows[:120], 5)


def test_passages_copies_runs_and_odd_rows(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["é", "of", "the"]) + str(rng.randint(0, 400))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join([" ".join(word() for _ in range(rng.randint(0, 50))), passage if i % 2 else "", " ".join(word() for _ in range(30))])) for i in range(120)]
    rows += [(200 + i, passage) for i in range(40)] + [(300, "run " * 500), (301, "run " * 30), (302, " ".join(passage.split()[:19])), (303, passage + " " + passage)]
    rows += [(400, None), (401, ""), (402, "  \n"), (None, passage), (None, "a b"), (None, None), (403, passage), (403, passage), (9000000000, "long " + " ".join(word() for _ in range(30000)))]
    check(spark, rows, 20)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 20)
    for r in substrings.dedup(docs, as_text=False).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_empty_table(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_interior_symbols_are_consistent():
    rng = np.random.default_rng(3)
    for size in (2, 5, 1000):
        middle = rng.integers(0, size, 40).astype(np.uint64)
        seen = []
        for _ in range(2):
            a, b = rng.integers(0, size, 13).astype(np.uint64), rng.integers(0, size, 17).astype(np.uint64)
            whole = recompression.mix(np.r_[a, middle, b])
            seen.append([{(int(s), int(x) - 13, int(y) - 13) for s, x, y in zip(sym, lo, hi, strict=True) if x >= 13 and y <= 53} for sym, lo, hi in recompression.rounds(whole, np.zeros(len(whole), np.int64))])
        assert seen[0] == seen[1]
