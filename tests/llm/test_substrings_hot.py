"""Windows that share one anchor: dealt to many tasks; and words whose simple fingerprints meet."""

import random

import pytest
from barloom.llm import recompression as rc
from barloom.llm import substrings
from test_substrings import check


def hot_rows():
    """Different documents of equal words but for one word in each window: all windows of the run have few anchors."""
    rng = random.Random(11)
    return [(i, "run " * 25 + f"x{rng.randrange(10**6)} " + "run " * 25) for i in range(200)]


def test_hot_anchors_are_split_and_results_stay(spark):
    rows = hot_rows() + [(1000 + i, t) for i, t in hot_rows()[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id as _id", "text as _text")
    hot = substrings.hot_anchors(docs, 20, rc.ROUNDS)
    assert len(hot)
    made = docs.mapInArrow(substrings._anchor_rows(20, rc.ROUNDS, hot), "anchor bigint, blob binary, fresh boolean")
    whole = docs.mapInArrow(substrings._anchor_rows(20, rc.ROUNDS, hot[:0]), "anchor bigint, blob binary, fresh boolean")
    most = lambda df: df.filter("fresh").selectExpr("anchor", "(length(blob) - 12) / 7 as n").groupBy("anchor").sum("n").agg({"sum(n)": "max"}).first()[0]
    assert 5 * most(made) < most(whole)
    check(spark, rows, 20)


def thue_morse(turns):
    word = "a"
    for _ in range(turns):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_of_equal_polynomial_fingerprints(spark):
    """A Thue-Morse word and its complement meet under every polynomial modulo a power of two."""
    one = thue_morse(11)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join([f"x{i}" if j % 20 == i else w for j in range(20)])) for i, w in enumerate([one, two])]
    check(spark, [(0, " ".join([one] * 20)), (1, " ".join([two] * 20)), (2, " ".join([one, two] * 15)), *[(10 + i, t) for i, t in rows]], 20)


def test_different_words_are_never_removed():
    with pytest.raises(ValueError, match="different windows"):
        substrings._without(b"a b c d", [{"begin": 1, "end": 3, "span": b"b x"}])
    assert substrings._without(b"a b c d", [{"begin": 1, "end": 3, "span": b"b c"}, {"begin": 2, "end": 3, "span": None}]) == ([b"a", b"d"], 4)
