"""Long chains of licence lines, texts of very many secrets, and pages whose marks are not clean."""

import random
import re

import duckdb
import pytest
from barloom.llm import html_crf, licenses, secrets

BY = "This work is licensed under a Creative Commons Attribution 4.0 International License."
CHAINS = [
    BY + "\nattribution 4 0 international license" * 4, BY + "\n4 0 international license" * 6, "4 0 international license\n" * 40 + BY + " attribution 4 0 international license" * 40,
    " ".join(["work is licensed"] * 50), BY.replace("licensed", "very much licensed") + "\nattribution 4 0 international license" * 9, BY * 30,
]


def test_repeated_lines_lose_no_notice(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(CHAINS)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 6), r.n_words) for r in licenses.scan(docs).collect()}
    assert [got[i][0] for i in range(len(CHAINS))] == ["cc-by", "cc-by", "cc-by", "", "cc-by", "cc-by"]
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    told = con.execute(f"SELECT doc_id, labels, round(score, 6), n_words FROM ({licenses.oracle()})").fetchall()
    assert {i: (labels, score, n) for i, labels, score, n in told} == got


def test_spans_of_a_chain_are_no_longer_than_a_notice(spark):
    docs = spark.createDataFrame(list(enumerate(CHAINS)), "doc_id long, text string")
    for r in licenses.spans(docs).filter("not phrase").collect():
        assert r.last - r.first < 2 * len(licenses.NOTICES[r.label].split()) + 2 * licenses.NEAR_DIAGONALS


@pytest.mark.parametrize("n", [1, 15, 16, 17, 4095, 30_000])
def test_many_secrets_in_one_text(spark, n):
    rng = random.Random(n)
    text = " ".join(f"{'é🙂'[rng.randrange(2)]}{rng.getrandbits(4 * k):0{k}x}" for k in (rng.choice([12, 16, 20]) for _ in range(n)))
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_hex == len(want) and [tuple(map(int, s.split(":")[1:])) for s in row.spans.split(",") if s.startswith("hex:")] == want


PAGES = {
    "<article><h1>x</h1><p title=it's>A</p><p>B It's done.</p></article>": ["x", "A", "B It's done."], "<script>var a;</script foo><p>Article</p>": ["Article"], "<style>p{}</style\n><p>Article</p>": ["Article"],
    "<p>text <button>Click</button> more</p><select><option>a<option>b</select><p>end</p>": ["text", "more", "end"], "<div><button>never closed<p>x</p></div><p>after</p>": ["after"],
    "<p a = 'x>y' b=\"1>2\" c>k</p>": ["k"], "<p title=\"open>z</p><p>q</p>": ["z", "q"], "<a href=x/>t</a><br/>u": ["t", "u"], "<p =a>v</p><p": ["v", "<p"], "<p a=b'c>d</p><p e=f\"g>h</p>": ["d", "h"],
}


def test_marks_that_are_not_clean():
    for page, want in PAGES.items():
        assert [text for text, _, _ in html_crf.blocks(page)] == want, page
