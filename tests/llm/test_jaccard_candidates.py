"""Candidates of the Jaccard join: common phrases tie no documents, and postings leave no table of their own."""

import os
import random
import re

import numpy as np
import pytest
from barloom.llm import jaccard


@pytest.fixture
def stored(monkeypatch):
    """The tables that a run stores, by name."""
    tables, kept = {}, jaccard.materialize

    def watched(df, name="step", few=False):
        tables[name] = kept(df, name, few)
        return tables[name]

    monkeypatch.setattr(jaccard, "materialize", watched)
    return tables


def with_a_common_line(n=400):
    rng = random.Random(3)
    line = " ".join(f"c{i}" for i in range(12))
    return [(i, f"{line} " + " ".join(f"w{rng.randrange(10**7)}" for _ in range(rng.choice([30, 80, 250])))) for i in range(n)]


def test_documents_with_a_common_line_are_no_candidates(spark, stored):
    rows = with_a_common_line()
    rows.append((1000, rows[7][1] + " end"))
    found = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == {i: 7 if i == 1000 else i for i, _ in rows}
    assert stored["members"].select("doc").distinct().count() < 20  # those of one cluster with others
    assert stored["placed"].count() < 20


def test_stored_are_documents_and_ties_alone(spark, stored):
    rows = with_a_common_line()
    jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert stored["sets"].count() < 2 * len(rows)
    size = sum(os.path.getsize(re.sub("^file:(//)?", "", f)) for f in stored["sets"].inputFiles())
    assert size < sum(len(t) for _, t in rows) / 10


def test_any_list_of_common_shingles_keeps_links():
    rng = np.random.default_rng(5)
    parts = jaccard.Parts(85)
    for _ in range(1500):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, n // 6) + 1))
        b = np.unique(np.r_[a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, drop + 1))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            told = np.unique(rng.choice(np.r_[a, b], int(rng.integers(0, n + 1))))
            assert np.intersect1d(parts.keys(a, jaccard._among(a, told)), parts.keys(b, jaccard._among(b, told))).size


def test_packed_postings_come_back():
    rng = np.random.default_rng(6)
    for docs in (np.arange(50), np.array([-(1 << 63), (1 << 63) - 1, 5]), np.array([jaccard.NO_ID + 7, 3]), np.array([9])):
        keys = np.sort(rng.integers(0, 1 << 64, 3000, np.uint64))
        which = rng.choice(docs, 3000).astype(np.int64)
        cut, back = jaccard._unpacked(jaccard._packed(keys, which))
        by = np.lexsort((which, keys))
        again = np.lexsort((back, cut))
        assert (cut[again] == (keys >> np.uint64(64 - jaccard.SLOT_BITS - 8 * jaccard.KEY_BYTES))[by]).all() and (np.sort(back) == np.sort(which)).all()


def test_near_copies_have_one_tie_a_stretch_and_block(spark, stored):
    """Ninety near copies share many lists; before, each was tied to the first of every one of them."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(base[: 4 * i] + [f"n{i}"] + base[4 * i + 1 :])) for i in range(90)]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.component_id for r in found} == {0}
    inside = stored["sets"].filter("n_shingles is null").select("a", "b")
    assert inside.distinct().count() <= 90


def test_forest_connects_what_ties_do():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 60, 200):
        a, b = rng.integers(-50, 50, n), rng.integers(-50, 50, n)
        name = {x: x for x in (*a.tolist(), *b.tolist())}
        for _ in range(len(name)):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                name[x] = name[y] = min(name[x], name[y])
        got = jaccard._forest(a, b)
        assert {y: x for x, y in got.tolist()} == {x: low for x, low in name.items() if x != low} and (np.diff(got[:, 1]) > 0).all()


def test_only_rows_of_repeated_ids_are_brought_together(spark):
    rows = [(i, f"{i} a b c d e f g {i}") for i in range(50)] + [(3, "3 a b c d e f g 3")] * 2 + [(None, "no id here"), (None, "no id here")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == list(range(50))
    assert kept.filter("doc_id is null").count() == 2
    plain = jaccard.one_of_each(spark.createDataFrame(rows[:50], "doc_id long, text string"))
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    window = re.search(r"Window \[row_number(.|\n)*?LeftSemi", plan)
    assert window and plain.count() == 50
