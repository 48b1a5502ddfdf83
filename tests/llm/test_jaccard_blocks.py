"""Blocks of the Jaccard join bounded by shingles, and list parts skipped by position."""

import random

import numpy as np
import pytest
from barloom.llm import jaccard


def test_few_long_texts_are_cut_into_blocks(spark, monkeypatch):
    """Sixty near copies of 500 shingles: one block by their number, more by their shingles."""
    rng, stored = random.Random(9), {}
    base = [f"w{rng.randrange(10**6)}" for _ in range(503)]
    rows = [(i, " ".join(base[:-1] + [f"new{i}"])) for i in range(60)]
    kept = jaccard.materialize

    def watched(df, name="step", few=False):
        stored[name] = kept(df, name, few)
        return stored[name]

    monkeypatch.setattr(jaccard, "materialize", watched)
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), shingles=5_000).collect()
    assert {r.component for r in found} == {0}
    assert stored["placed"].selectExpr("max(blocks)").first()[0] >= 6


@pytest.mark.parametrize("percent", [60, 85])
def test_link_sets_connects_what_all_pairs_do(percent):
    rng = np.random.default_rng(10)
    for _ in range(20):
        base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        sets = [np.unique(np.r_[base[: rng.integers(20, 400)], rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)]) for _ in range(60)]

        def named(links):
            name = list(range(60))
            for a, b in links:
                name = [name[a] if x == name[b] else x for x in name]
            return [name.index(x) for x in name]

        pairs = [(i, j) for i in range(60) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - n)]
        assert named(jaccard.link_sets(list(range(60)), sets, percent)) == named(pairs)


def test_words_of_equal_polynomial_fingerprints_are_not_linked(spark):
    """A Thue-Morse word and its complement meet under every polynomial modulo a power of two."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(["x", "y", word, "z"])), (2, " ".join(["x", "y", other, "z"]))]
    assert {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 2}
