"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
from barloom.llm import jaccard
from barloom.llm.graph import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k=4, percent=85):
    rows = list(dict.fromkeys(rows))
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return {(doc, t): (len(sets[i]), low.get(root(i))) for i, (doc, t) in enumerate(rows)}


def check(spark, rows, k=4, percent=85, block=jaccard.BLOCK):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, key string, component long").repartition(3)
    want = brute(rows, k, percent)
    got = sorted(((r["_id"], r.n_shingles, r.component if r.component < jaccard.NO_ID else None) for r in jaccard.classes(df, k=k, percent=percent, block=block).collect()), key=repr)
    assert got == sorted(((i, *want[i, t]) for i, t in rows), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_and_odd_rows(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 30, 120, 700]))]
        rows += [(len(rows) + j, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5]))) for j in range(rng.randint(1, 12))]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "b a"), (1006, rows[0][1]), (1006, rows[0][1]), (None, rows[0][1]), (None, "only one null"), (None, None)]
    rows += [(2000, "x " * 30000), (2001, "x y " * 3)]
    check(spark, rows)
    check(spark, rows[:80], k=2, percent=60)


def test_chains_and_blocks(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        rows.append((i, edited(rng, rows[rng.randrange(len(rows))][1].split(), rng.choice([1, 2, 3, 4]))))
    rng.shuffle(rows)
    check(spark, rows, block=16)


def test_whole_table_and_one_of_each(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == {i: v for (i, _), v in want.items()}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v[1] for v in want.values()})


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n int")
    assert jaccard.join(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_parts_always_share_one():
    rng = np.random.default_rng(1)
    parts = jaccard.Parts(85)
    for _ in range(3000):
        n = int(rng.integers(1, 200))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        drop = int(rng.integers(0, max(1, n // 6) + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, drop + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            assert np.intersect1d(parts.keys(a), parts.keys(b)).size


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 600)] + [(700, 700)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 500 for i in range(500, 600)) and 700 not in got
