"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from barloom.llm import pieces, queries
from barloom.llm.pieces import PieceBpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def texts(rng, bpe, n):
    own = list(bpe.ids)
    chars = [c for p in own for c in p]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            yield "".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
        elif kind < 0.6:
            yield "".join(rng.choice(own) for _ in range(rng.randint(0, 14))).replace("▁", " ")
        elif kind < 0.8:
            yield "".join(rng.choice("ab  \n\t\rthe▁é中\U0001f600\x00\x1c\x85") for _ in range(rng.randint(0, 60)))
        else:
            yield "".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x400, 0xD7FF)])) for _ in range(rng.randint(0, 30)))


def test_ids_and_texts_equal_the_librarys(library):
    bpe, rng = PieceBpe(MODEL), random.Random(4)
    for text in texts(rng, bpe, 6000):
        ids = bpe.encode(text)
        assert numbers(ids) == library.encode(text)
        assert bpe.decode(ids) == library.decode(numbers(ids)) == text.replace("▁", " ")
        some = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))]
        assert bpe.decode(np.array(some, "<u4").tobytes()) == library.decode(some)


def test_every_piece_and_every_prefix(library):
    """Each piece alone; and the table's last token of every prefix is the last of that prefix's own encoding."""
    bpe = PieceBpe(MODEL)
    for piece in bpe.ids:
        assert numbers(bpe.encode(piece)) == library.encode(piece)
    unit = "▁unbelievablenessantidisestablishment'scountéré"
    last, _ = bpe.prefix_table(unit)
    assert [last[i] for i in range(1, len(unit) + 1)] == [library.encode(unit[1:i])[-1] if i > 1 else bpe.ids["▁"] for i in range(1, len(unit) + 1)]


def test_the_pair_test_is_that_of_merging():
    """Whether two tokens stay apart, told from their edges, is what merging their joined text tells."""
    bpe, rng = PieceBpe(MODEL), random.Random(1)
    ids = list(bpe.ids.values())
    for _ in range(20_000):
        joined = bpe.pieces[rng.choice(ids)] + bpe.pieces[rng.choice(ids)]
        at = rng.randint(1, len(joined) - 1)
        if joined[:at] in bpe.ids and joined[at:] in bpe.ids:
            own = [joined[:at], joined[at:]]
            assert bpe.fits(*map(bpe.ids.__getitem__, own)) == (bpe.merged(joined) == own)


def test_kept_units_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_UNITS", 3)
    monkeypatch.setattr(pieces, "SLOTS", 4)
    bpe = PieceBpe(MODEL)
    for text in texts(random.Random(9), bpe, 400):
        assert numbers(bpe.encode(text)) == library.encode(text)
    assert len(bpe.old) + len(bpe.young) < 200


def test_rows(spark, library):
    rows = [(1, None), (1, ""), (1, ""), (None, "a  b\n"), (2, "<s> </s> <unk> <0x41>"), (3, "xy" * 150_000), (4, " " * 50_000), (5, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, 5, b"x") for r in rows], "doc_id long, text string, n_tokens long, ids binary").repartition(3)
    got = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    key = lambda r: (str(r[0]), str(r[1])[:50])
    expected = [(i, [1, *library.encode(t or ""), 2], t or "") for i, t in rows]
    assert sorted(((r.doc_id, numbers(r.ids), r.decoded) for r in got), key=key) == sorted(expected, key=key)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert [numbers(r.ids) for r in pieces.encode(docs, MODEL, begin_end=False).filter("doc_id = 1").collect()] == [[]] * 3
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_sentencepiece(spark, sf).collect()
    assert len(rows) == len(docs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert tuple(r) == (r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))
